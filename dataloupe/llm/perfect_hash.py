"""Minimal perfect hashing of 32-bit keys in numpy, in segments of bounded size.

A segment holds the keys with one value of a first hash. Its keys are hashed into a row of bits twice
as long as they are many; keys that are alone at their bit set it, the others go on to the next,
shorter row. A key's number is the count of set bits before its own, so n keys have the numbers 0
to n - 1. Each key is stored at its number, so that a key that was never hashed is recognized.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD = 64
SEED = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well spread bits of each key: two rounds of xor, shift and multiply."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + SEED * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(segments)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sizes, words, stored)`` of distinct keys: the words of each row, all rows' bits as 64-bit
    words one row after the other, and the keys in order of their numbers."""
    sizes, rows, placed = [], [], []
    left = np.asarray(keys, np.uint32)
    while len(left):
        words = -(-2 * len(left) // WORD)
        at = (mixed(left, len(sizes) + 1) % np.uint64(words * WORD)).astype(np.int64)
        alone = np.bincount(at, minlength=words * WORD)[at] == 1
        here = at[alone]
        bits = np.zeros(words * WORD, np.uint8)
        bits[here] = 1
        rows.append(np.packbits(bits, bitorder="little").view(np.uint64))
        placed.append(left[alone][np.argsort(here)])
        sizes.append(words)
        left = left[~alone]
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return np.asarray(sizes, np.int64), np.concatenate(rows), np.concatenate(placed)


@dataclass
class Hash:
    """Several segments as one hash: numbers go on from segment to segment, in the order given."""

    segments: int  # of the first hash
    place: np.ndarray  # of each segment in this hash, or -1
    starts: np.ndarray  # first word of each row, by place
    sizes: np.ndarray  # words of each row, by place; 0 behind the last
    words: np.ndarray
    before: np.ndarray  # set bits before each word
    stored: np.ndarray  # keys by number

    @classmethod
    def of(cls, segments: int, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Hash:
        """``parts`` are (segment, sizes, words, stored) as ``build`` gives them."""
        place = np.full(segments, -1, np.int64)
        depth = max([len(p[1]) for p in parts], default=0) + 1
        sizes, starts = (np.zeros((len(parts), depth), np.int64) for _ in range(2))
        first = 0
        for i, (segment, rows, _, _) in enumerate(parts):
            place[segment] = i
            sizes[i, : len(rows)] = rows
            starts[i, : len(rows)] = first + np.cumsum(rows) - rows
            first += int(rows.sum())
        words = np.concatenate([np.zeros(0, np.uint64), *[p[2] for p in parts]])
        counts = np.bitwise_count(words).astype(np.int64)
        stored = np.concatenate([np.zeros(0, np.uint32), *[p[3] for p in parts]])
        return cls(segments, place, starts, sizes, words, np.cumsum(counts) - counts, stored)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys of other segments and for unknown keys."""
        out = np.full(len(keys), -1, np.int64)
        place = self.place[segment_of(keys, self.segments)]
        rest = np.flatnonzero(place >= 0)
        for row in range(self.sizes.shape[1]):
            size = self.sizes[place[rest], row]
            rest, size = rest[size > 0], size[size > 0]
            if not len(rest):
                break
            at = (mixed(keys[rest], row + 1) % (size * WORD).astype(np.uint64)).astype(np.int64)
            word = self.starts[place[rest], row] + at // WORD
            bit = (at % WORD).astype(np.uint64)
            bits = self.words[word]
            found = (bits >> bit & np.uint64(1)).astype(bool)
            below = bits & ((np.uint64(1) << bit) - np.uint64(1))
            number = self.before[word] + np.bitwise_count(below).astype(np.int64)
            hit = found & (self.stored[np.where(found, number, 0)] == keys[rest])
            out[rest[hit]] = number[hit]
            rest = rest[~found]
        return out

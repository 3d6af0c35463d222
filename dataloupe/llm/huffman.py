"""Canonical Huffman codes of limited length, encoded and decoded by whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_BITS = 20
EVERY = 256  # ids between two bit-offset checkpoints
WORD = 32


def code_lengths(counts: np.ndarray, limit: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge).

    Level by level, neighbours of the list so far are packaged in pairs and merged with the
    symbols in order of count. Walking back, the first 2n - 2 items are chosen of the last
    level, of the level before those that the chosen packages hold, and so on; a symbol is as
    long as the number of levels at which it is chosen.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.float64)[order]
    row, is_symbol = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        row = both[place]
        is_symbol.append(place < n)
    lengths, chosen = np.zeros(n, np.int64), 2 * n - 2
    for symbols in reversed(is_symbol):
        taken = int(symbols[:chosen].sum())
        lengths[:taken] += 1
        chosen = 2 * (chosen - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Codebook:
    """The canonical code of some ids: shorter codes first, equal lengths by id."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.ids, self.lengths))
        ids, lengths = self.ids[order].astype(np.int64), self.lengths[order].astype(np.int64)
        self.bits = int(lengths.max(initial=1))
        # A code of length l is a run of 2^(bits - l) entries of the decoding table.
        runs = np.left_shift(1, self.bits - lengths)
        first = np.cumsum(runs) - runs
        size = int(ids.max(initial=0)) + 1
        self.length = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.uint64)
        self.length[ids] = lengths
        self.code[ids] = first >> (self.bits - lengths)
        table = np.repeat(ids << 6 | lengths, runs)
        self.table = np.full(1 << self.bits, 1, np.int64)  # entries that no code reaches
        self.table[: len(table)] = table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids`` and the bit offset of every ``EVERY``-th of them."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        word, shift = at // WORD, at % WORD
        # In the 64 bits that begin with the word, the code comes after ``shift`` bits.
        value = self.code[ids] << (2 * WORD - shift - lengths).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1]) // WORD + 2, np.uint64)
        out[word[new]] += np.add.reduceat(value >> np.uint64(WORD), new)
        out[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
        return out.astype(">u4").tobytes(), at[::EVERY]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a payload. All stretches between checkpoints advance together, one
        table look-up per step."""
        if not n:
            return np.empty(0, np.int64)
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        last = len(words) - 2
        at = checkpoints.astype(np.int64)
        out = np.empty((EVERY, len(at)), np.int64)
        keep = np.uint64(2 * WORD - self.bits)
        for step in range(min(EVERY, n)):
            word = np.minimum(at // WORD, last)
            window = words[word] << np.uint64(WORD) | words[word + 1]
            window <<= (at % WORD).astype(np.uint64)
            entry = self.table[(window >> keep).astype(np.int64)]
            out[step] = entry >> 6
            at += entry & 63
        return out.T.reshape(-1)[:n]

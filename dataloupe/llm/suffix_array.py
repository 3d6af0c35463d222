"""Suffix sorting of byte strings in two stages, and what windows have in common."""

from __future__ import annotations

import numpy as np

MARGIN = 64  # bytes that must follow the last position asked for
BLOCK = 1 << 17  # sorted positions compared at a time


def word_view(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def place_type(n: int) -> type:
    """The smallest type of numbers for positions below ``n``, less one included."""
    return np.int32 if n <= np.iinfo(np.int32).max else np.int64


def _smaller(data: np.ndarray) -> np.ndarray:
    """For each position whether its suffix is smaller than the next one; true for the last."""
    small = np.append(data[:-1] < data[1:], True)
    equal = np.flatnonzero(data[:-1] == data[1:])
    if len(equal):
        # All positions up to a place where a byte differs from the next one compare as that does.
        last = np.flatnonzero(np.append(np.diff(equal) != 1, True))
        small[equal] = np.repeat(small[equal[last] + 1], np.diff(last, prepend=-1))
    return small


def sort_windows(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``wanted`` (ascending) in the order of their suffixes, to ``depth`` bytes.

    Two stages (Itoh and Tanaka, 1999). Only suffixes smaller than their successors are sorted
    directly, by their words. The others are induced: the buckets of first bytes are scanned
    in ascending order, and each suffix met puts the one before it, if that is larger than
    it, next into the bucket of its own first byte. Suffixes on which no wanted one
    depends are left out of both stages. ``data`` has ``MARGIN`` bytes after the last of them.
    """
    n = len(data)
    kind = place_type(n)
    small = _smaller(data)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    # Needed is all from a wanted place up to the next small one.
    places = np.arange(n, dtype=kind)
    asked, passed = (np.where(x, places, kind(-1)) for x in (is_wanted, small))
    del places
    np.maximum.accumulate(asked, out=asked)
    np.maximum.accumulate(passed, out=passed)
    needed = is_wanted.copy()
    needed[1:] = asked[1:] > passed[:-1]
    del asked, passed
    direct = np.flatnonzero(needed & small).astype(kind)
    words = word_view(data)
    # Last words first, so that one word per place is held at a time.
    for offset in reversed(range(0, depth, 8)):
        word = words[direct + offset].astype(np.uint64)
        direct = direct[np.argsort(word, kind="stable")]
        del word
    firsts = np.concatenate([[0], np.cumsum(np.bincount(data[direct], minlength=256))])
    induced = needed & ~small
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def scan(met: np.ndarray, byte: int) -> np.ndarray:
        """Queues the larger suffixes before those met; gives the ones of the same bucket."""
        order.append(met)
        before = met[met > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return before
        first = data[before]
        sorting = np.argsort(first, kind="stable")
        before, first = before[sorting], first[sorting]
        cuts = np.flatnonzero(np.diff(first)) + 1
        same = before[:0]
        for group in np.split(before, cuts):
            if (target := int(data[group[0]])) == byte:
                same = group
            else:
                queues[target].append(group)
        return same

    for byte in range(256):
        met = np.concatenate(queues[byte]) if queues[byte] else direct[:0]
        while len(met):
            met = scan(met, byte)
        met = direct[firsts[byte] : firsts[byte + 1]]
        if len(met):
            scan(met, byte)
    sorted_places = np.concatenate(order) if order else direct
    order.clear(), queues.clear()
    return sorted_places[is_wanted[sorted_places]]


def same_as_before(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each sorted position whether its common prefix with the one before it has at least
    ``length`` bytes; false for the first."""
    words = word_view(data)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), BLOCK):
        part = order[at - 1 : at + BLOCK]
        alike = np.ones(len(part) - 1, bool)
        for offset in [*range(0, length - 7, 8), length - 8]:
            word = words[part + offset]
            alike &= word[1:] == word[:-1]
        same[at : at + BLOCK] = alike
    return same

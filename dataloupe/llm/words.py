"""Words of a text as bytes, for hashing."""

from __future__ import annotations

from zlib import crc32

import numpy as np

# ASCII that is no letter or digit becomes a space, the rest is unchanged.
_TABLE = bytes(
    b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)

# The same, with lower-case letters for A to Z.
_LOWER = _TABLE.lower()

SHORT = 24


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, values >> 1 ^ np.uint32(0xEDB88320), values >> 1)
    return values


_CRC = _crc_table()


def _split(text: str) -> bytes:
    """The bytes of a text's lower-cased words with spaces for all other characters."""
    return text.encode().translate(_LOWER) if text.isascii() else text.lower().encode().translate(_TABLE)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text: what is left between ASCII punctuation and white space."""
    return (text or "").lower().encode().translate(_TABLE).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """The CRC-32 of each word, as unsigned 64-bit integers."""
    return np.fromiter(map(crc32, found), np.uint64, len(found))


def hashes_of_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ``word_hashes`` of all words of several texts, and how many words each text has.

    CRC-32 goes through the first byte of all words at once, then through the second one, and so
    on. Words of more than ``SHORT`` bytes are hashed one by one.
    """
    found = [_split(t or "") for t in texts]
    whole = b" ".join([b"", *found, b""])
    data = np.frombuffer(whole, np.uint8)
    spaces = np.flatnonzero(data == 32)
    gaps = np.diff(spaces)
    some = np.flatnonzero(gaps > 1)
    starts, sizes = np.take(spaces, some) + 1, np.take(gaps, some) - 1
    short = np.minimum(sizes, SHORT + 1).astype(np.uint8)
    order = np.argsort(np.uint8(SHORT + 1) - short, kind="stable")
    first = np.take(starts, order)
    longer = len(sizes) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
    sums = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for at, n in enumerate(longer[:SHORT].tolist()):  # n words have more than ``at`` bytes
        if not n:
            break
        part = sums[:n]
        place = np.take(data[at:], first[:n]) ^ part.astype(np.uint8)
        part >>= np.uint32(8)
        part ^= np.take(_CRC, place)
    sums ^= np.uint32(0xFFFFFFFF)
    for i in range(int(longer[SHORT])):
        sums[i] = crc32(whole[first[i] : first[i] + sizes[order[i]]])
    hashes = np.empty(len(sizes), np.uint64)
    hashes[order] = sums
    bounds = np.cumsum([1, *(len(x) + 1 for x in found)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing (the finaliser of SplitMix64)."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return total

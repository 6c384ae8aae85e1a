"""Words of whole columns at once: places, 64-bit hashes and distinct words, on the bytes of an Arrow column."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes handled at once, and the length beyond which a single word is hashed on its own.
CHUNK, LONG = 1 << 21, 1 << 12
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
POWER = np.cumprod(np.full(LONG + 1, 0x5851F42D4C957F2D, np.uint64))
#: True where a byte parts words: the six ASCII blanks, or every ASCII byte that is no letter.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NO_LETTERS = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A to Z lower-cased."""
    return _LOWER[data]


def latin_lower(data: np.ndarray) -> np.ndarray:
    """A to Z and the capitals of U+00C0 to U+00DE lower-cased; the length stays."""
    out = _LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def find(data: np.ndarray, at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words; no word goes beyond its row."""
    inside = ~parts[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = np.unique(at)
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out, sizes, i = np.zeros(len(starts), np.uint64), ends - starts, 0
    while i < len(starts):
        if sizes[i] > LONG:
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        if (long := np.flatnonzero(sizes[i:j] > LONG)).size:
            j = i + int(long[0])
        n = sizes[i:j]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        values = BYTE[data[place + np.repeat(starts[i:j], n)]] * POWER[place]
        out[i:j] = np.add.reduceat(values, first)
        i = j
    return mix(out ^ sizes.astype(np.uint64))


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of words set off by a blank on both sides: buckets, and each word's first place."""
    n = ends - starts
    first = np.cumsum(n + 2) - (n + 2)
    own = np.full(int((n + 2).sum()) + max(sizes), 32, np.uint64)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own[place + np.repeat(first + 1, n)] = data[place + np.repeat(starts, n)]
    total = len(own) - max(sizes)
    found = np.empty((total, len(sizes)), np.int64)
    rolled = np.zeros(total, np.uint64)
    for k in range(max(sizes)):
        rolled = (rolled + own[k : k + total] + _U(1)) * _U(0x9E3779B97F4A7C15)
        if k + 1 in sizes:
            found[:, sizes.index(k + 1)] = (mix(rolled + _U(k)) % _U(buckets)).astype(np.int64)
    # a gram that would begin in one word and end in the next counts as the gram of the closing blank alone
    left = np.repeat(first + n + 2, n + 2) - np.arange(total)
    for i, k in enumerate(sizes):
        found[left < k, i] = i
    return found, first


def distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, a place of each, and for every word the number of its hash."""
    return np.unique(words, return_index=True, return_inverse=True)

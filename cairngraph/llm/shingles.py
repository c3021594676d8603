"""Hashed word shingles of whole texts, in numpy over bounded pieces."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes of text whose hashes are computed at once.
PIECE = 1 << 20


def _fixed(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers of a seeded generator."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64) | _U(1)


_BYTE = _fixed(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = _fixed(12, 8)
_POWERS = np.ones(4096, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, 4096):
        _POWERS[_i] = _POWERS[_i - 1] * _ODD[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _ODD[1]
        x = (x ^ (x >> _U(29))) * _ODD[2]
        return x ^ (x >> _U(32))


def _words(data: np.ndarray) -> np.ndarray:
    """A hash per word of a piece that begins and ends between words."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.zeros(len(data), np.int64)
    first[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(first)
    with np.errstate(over="ignore"):
        # past the table of powers, a long word's places start again under another odd factor
        value = _BYTE[data] * _POWERS[place & 4095]
        if int(lengths.max()) > 4096:
            value *= (place >> 12).astype(np.uint64) * _U(2) + _U(1)
        value[space] = 0
        sums = np.add.reduceat(value, starts)
        # reduceat sums up to the next start: the white space between adds 0
        return mix(sums + lengths.astype(np.uint64) * _ODD[3])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= PIECE:
        return _words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; with fewer words, the whole sequence is one; without words, none."""
    h = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * _ODD[4] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


class MinHash:
    """Minima of many universal hashes (multiply, add, take the high half) of a set; the first bands x rows of them make the band keys."""

    def __init__(self, bands: int, rows: int, minima: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.a, self.b = _fixed(seed, minima), _fixed(seed + 1, minima)
        self.salt = _fixed(seed + 2, bands)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), 512):
                x = hashes[at : at + 512, None] * self.a
                x += self.b
                out = np.minimum(out, x.view(np.uint32)[:, 1::2].min(axis=0))
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        m = minima[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            out = self.salt.copy()
            for i in range(self.rows):
                out = mix(out * _ODD[5] + m[:, i])
        return out.view(np.int64)

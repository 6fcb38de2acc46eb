"""Distinct hashed word shingles of whole texts, and their one-permutation sketches."""

from __future__ import annotations

import numpy as np

from . import textbuf as tb

_random = np.random.default_rng(20240131)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_ODD = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    begin = np.zeros(n + 1, bool)
    begin[offs] = True
    starts = np.flatnonzero(~space & (begin[:-1] | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(~space & (begin[1:] | np.concatenate([space[1:], [True]]))) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return tb.mix64((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of a block (A-Z lower-cased), and the rows' offsets in them.

    A document that is longer than a block is cut at spaces, so that temporary arrays stay small.
    """
    if len(offs) > 2 or len(data) <= 2 * tb.BLOCK:
        return _words(data, offs)
    parts, at = [], 0
    while at < len(data):
        cut = at + tb.BLOCK
        while cut < len(data) and not _SPACE[data[cut]]:
            near = np.flatnonzero(_SPACE[data[cut : cut + 4096]])
            cut += int(near[0]) if len(near) else 4096
        cut = min(cut, len(data))
        parts.append(_words(data[at:cut], np.array([0, cut - at]))[0])
        at = cut
    found = np.concatenate(parts)
    return found, np.array([0, len(found)])


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5):
    """The sorted distinct shingles of each row; with fewer words the whole sequence is one, without words there is none."""
    words, at = word_hashes(data, offs)
    every = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        every += words[k : k + len(every)] * _ODD[k]
    every = tb.mix64(every)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= size:
            got = np.sort(every[s : e - size + 1])
            yield got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif e > s:
            yield tb.mix64(np.array([(words[s:e] * _ODD[8 : 8 + e - s]).sum() + np.uint64(e - s)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Sketcher:
    """One-permutation hashing: the hash space is cut into `bins` ranges, and each bin keeps the least hash in it.

    An empty bin takes the value of the first filled bin in its own fixed pseudo-random order (optimal densification).
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.probe = self._probes(0, 128)

    def _probes(self, first: int, n: int) -> np.ndarray:
        cell = np.arange(self.bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(first, first + n, dtype=np.uint64)
        return ((tb.mix64(cell + np.uint64(0x5851F42D)) >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)

    def sketch(self, sorted_set: np.ndarray) -> np.ndarray:
        of = ((sorted_set >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        value, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        value[of[first]] = sorted_set[first]
        filled[of[first]] = True
        empty, probe, seen = np.flatnonzero(~filled), self.probe, 0
        while len(empty):
            hit = filled[probe[empty]]
            at = hit.argmax(1)
            ok = hit[np.arange(len(empty)), at]
            value[empty[ok]] = value[probe[empty[ok], at[ok]]]
            empty, seen = empty[~ok], seen + probe.shape[1]
            if len(empty):
                probe = self._probes(seen, 1024)
        return value

    def keys(self, sorted_set: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band; bands never share a key by design."""
        value = tb.mix64(self.sketch(sorted_set)).reshape(self.bands, self.rows)
        return tb.mix64((value * _ODD[16 : 16 + self.rows]).sum(1, dtype=np.uint64) + _ODD[40] * np.arange(1, self.bands + 1, dtype=np.uint64))


def fingerprint(sorted_set: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(sorted_set.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(tb.mix64(sorted_set * _ODD[50])).astype(np.int64)) if len(sorted_set) else 0

"""Word shingles of one text, and its circulant MinHash signature; plain functions for Python workers.

Texts come as UTF-8 bytes: ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at space and
x09-x0D only, which is the word rule of these operators.
"""

from __future__ import annotations

import numpy as np
import xxhash

UNIVERSE_BITS = 20
_CACHE_WORDS = 200_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; with fewer words than ``size``, all words as one; without words, none."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


class Shingler:
    """64-bit hashes of the distinct shingles of a text."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def hashes(self, text: bytes) -> np.ndarray:
        known = self.known
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        count = len(h) - size + 1
        out = np.full(count, size, np.uint64)
        for i in range(size):
            out = mixed(out * _M2 + h[i : i + count])
        return np.unique(out)


class Circulant:
    """MinHash from two permutations: the first places shingles, the second is read at circular shifts.

    Coordinate k of a signature is the least value that the second permutation, shifted by k, takes
    on the places of the set.  All coordinates of one shingle are thus one run of a table.
    """

    def __init__(self, bands: int, rows: int, seed: int):
        size = 1 << UNIVERSE_BITS
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.width = bands, rows, bands * rows
        self.first = rng.permutation(size)
        second = rng.permutation(size).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: self.width]]), self.width)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.first[(hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
        least = self.runs[places[:2_048]].min(axis=0)
        for at in range(2_048, len(places), 2_048):
            least = np.minimum(least, self.runs[places[at : at + 2_048]].min(axis=0))
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; keys of different bands differ by their salt."""
        grid = signature.reshape(self.bands, self.rows).astype(np.uint64)
        keys = self.salt
        for j in range(self.rows):
            keys = mixed(keys * _M1 + grid[:, j])
        return keys.view(np.int64)

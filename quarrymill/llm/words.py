"""Words of texts and the sketches that near-duplicate operators share.

The shared-word degree of two texts is 2 c / (a + b), c being the number of words in common, counted with repetition.
With the k-th occurrence of a word as an element of its own, texts are sets, and the degree is that of sets. Elements are
64-bit hashes of (word, k).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
import xxhash

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
DEGREE = 0.8
#: The longest partner of a set of n elements has LONGEST * n.
LONGEST = (2 - DEGREE) / DEGREE


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sets:
    """Sets of elements, one after the other: flat, sorted within each, and their sizes."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat, self.n = flat, n
        self.start = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.n)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i + 1]]

    def rows(self) -> np.ndarray:
        """For each element, the set it is in."""
        return np.repeat(np.arange(len(self.n)), self.n)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


class Elements:
    """Elements of texts; words met before are not hashed again."""

    MOST = 300_000

    def __init__(self):
        self.known = _Hashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct elements of a text."""
        return self.sets([text]).flat

    def sets(self, texts: list[str | None]) -> Sets:
        """The elements of many texts; a null text has none."""
        if len(self.known) > self.MOST:
            self.known.clear()
        known, hashes, n = self.known, [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                found = words(text)
                n[i] = len(found)
                hashes.extend([known[w] for w in found])
        flat = np.array(hashes, dtype=np.uint64)
        row = np.repeat(np.arange(len(texts)), n)
        order = np.lexsort((flat, row))
        flat = flat[order]
        # the k-th occurrence of a word within its text
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        at = np.arange(len(flat))
        k = at - np.maximum.accumulate(np.where(first, at, 0))
        flat = (mix(flat ^ mix(k.astype(np.uint64), 31), 7) >> np.uint64(1)).astype(np.int64)
        return Sets(flat[np.lexsort((flat, row))], n)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def alike(a: np.ndarray, b: np.ndarray, degree: float = DEGREE) -> bool:
    n = len(a) + len(b)
    return n > 0 and 2 * common(a, b) >= degree * n - 1e-9


class Weights:
    """Weights of elements as two arrays sorted by element; an element that is not listed weighs most."""

    def __init__(self, elements: np.ndarray, weights: np.ndarray):
        order = np.argsort(elements)
        self.elements, self.weights = elements[order].astype(np.int64), weights[order].astype(np.float64)
        self.heaviest = float(self.weights.max()) if len(self.weights) else 1.0

    def of(self, elements: np.ndarray) -> np.ndarray:
        if not len(self.elements):
            return np.ones(len(elements))
        at = np.searchsorted(self.elements, elements).clip(max=len(self.elements) - 1)
        return np.where(self.elements[at] == elements, self.weights[at], self.heaviest)


def band_keys(sets: Sets, weights: Weights, bands: int, rows: int) -> np.ndarray:
    """(number of sets, bands) 64-bit keys by weighted min-hashing.

    Two sets agree in a band with the rows-th power of their weighted similarity: the weight of their common elements
    over that of all their elements. The minimum of exponential variables with the weights as rates picks an element in
    proportion to its weight. Empty sets get no sensible key.
    """
    if not len(sets):
        return np.zeros((0, bands), dtype=np.int64)
    distinct, inverse = np.unique(sets.flat, return_inverse=True)
    rate = (1.0 / weights.of(distinct)).astype(np.float32)
    full = sets.n > 0
    starts = sets.start[:-1][full]
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    base = distinct.astype(np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, dtype=np.uint64)
        for row in range(rows):
            h = mix(base, band * rows + row + 1)
            u = ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
            cost = -np.log(u) * rate
            # the least cost stands for its element; two elements of one cost would only make a needless candidate
            least = np.zeros(len(sets), dtype=np.uint64)
            if len(starts):
                low = np.full(len(sets), np.inf, dtype=np.float32)
                low[full] = np.minimum.reduceat(cost[inverse], starts)
                least = low.view(np.uint32).astype(np.uint64)
            key = mix(key ^ least, 977)
        out[:, band] = key
    return out.view(np.int64)

"""Word shingles as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Most words whose hashes a worker remembers.
CACHED = 100_000
_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word) | 1
        if len(self) < CACHED:
            self[word] = value
        return value


_HASHES = _Hashes()


def cells(texts: list[str | None], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The unit cells of every text's weighted shingle set, and where each text's cells begin (and end).

    A shingle that occurs n times has n cells, so the Jaccard similarity of two cell sets is
    the weighted one of the texts. A text with fewer words than a shingle has one shingle
    of all of them, one without words has none. Cells of a text are sorted.
    """
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([max(len(f), width) if f else 0 for f in found], np.int64)
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for f, end, size in zip(found, ends, sizes):
        if f:
            flat[end - size : end - size + len(f)] = np.fromiter(map(_HASHES.__getitem__, f), np.uint64, len(f))
    counts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.r_[0, np.cumsum(counts)]
    at = np.arange(len(owner)) - starts[owner] + (ends - sizes)[owner]
    shingle = np.zeros(len(owner), np.uint64)
    for k in range(width):
        shingle = mix(shingle + _GOLD) ^ (flat[at + k] * _M2)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    if len(shingle):
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]
        nth = np.arange(len(shingle)) - np.maximum.accumulate(np.where(new, np.arange(len(shingle)), 0))
        shingle = mix(shingle + nth.astype(np.uint64) * _GOLD)
    return shingle, starts


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of cells; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)

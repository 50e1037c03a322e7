"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sonoframe.llm.common import ragged_index, sums, text_buffer

#: Words in a shingle.
WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(5).integers(1 << 62, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COUNTS = np.random.default_rng(6).integers(1 << 62, size=WORDS + 1, dtype=np.uint64)

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 1024), _PRIME, np.uint64)
        base[0] = 1
        _powers = np.cumprod(base)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, with A-Z as a-z, and each text's offset among them."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = ~space[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(start) - 1, 0)]
    place[space] = 0
    value = (_LOWER[data] + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    value[space] = 0
    length = np.add.reduceat(~space, starts, dtype=np.uint64)
    return mix(np.add.reduceat(value, starts) + length * _PRIME), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text in ascending order, and each text's offset among them.

    A shingle is ``WORDS`` words in a row, or all words of a text with fewer; a
    text without words (or null) has none.
    """
    words, at = word_hashes(*text_buffer(column))
    count = np.diff(at)
    whole = np.maximum(count - WORDS + 1, 0)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    size = whole.copy()
    size[short] = 1
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    total = np.full(to[-1], _COUNTS[WORDS])
    place = ragged_index(to[:-1], whole)
    begin = ragged_index(at[:-1], whole)
    sums_of = total[place]
    for i in range(WORDS):
        sums_of += words[begin + i] * _PLACES[i]
    total[place] = sums_of
    if len(short):
        few = _COUNTS[count[short]].copy()
        for i in range(WORDS - 1):
            more = count[short] > i
            few[more] += words[at[short[more]] + i] * _PLACES[i]
        total[to[short]] = few
    total = mix(total)
    doc = np.repeat(np.arange(len(count)), size)
    if len(total) >= 64 * len(count):  # few long texts: each is sorted by itself
        for a, b in zip(to.tolist(), to[1:].tolist(), strict=False):
            total[a:b].sort()
    else:
        total = total[np.lexsort((total, doc))]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[new], np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(doc[new], minlength=len(count)))])


def set_ids(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, the same for equal sets."""
    n = np.diff(at).astype(np.uint64)
    return mix(sums(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at) + n * _PRIME).view(np.int64)

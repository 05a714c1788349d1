"""Word shingles of texts as 64-bit numbers, and their SuperMinHash signatures.

SuperMinHash gives every element its own permutation of the m slots. In step j
the element offers the value j + r, r in [0, 1), to the j-th slot of its
permutation, and every slot keeps the least offer. Within an element the values
of the slots are thus correlated ranks instead of independent draws, which lowers
the variance of the estimate. As soon as every slot has an offer, later steps,
whose offers are all larger, cannot change anything and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
SLOTS = 128
CACHE = 200_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordNumbers(dict):
    """Word -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number


def shingle_set(text: str, numbers: WordNumbers, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a whole text; A-Z are folded, words end at ASCII white space.

    Fewer words than ``size`` make one shingle of them all; no words make none.
    """
    words = text.encode().lower().split()
    hashed = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(words):
        return hashed
    count, size = max(1, len(words) - size + 1), min(size, len(words))
    out = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_GOLDEN) + hashed[k : k + count])
    return np.unique(out)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share, whatever their order."""
    first = mix(shingles).sum(dtype=np.uint64)
    second = mix(shingles ^ np.uint64(_GOLDEN)).sum(dtype=np.uint64)
    return np.array([first, second], dtype="<u8").tobytes()


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` values per set; ``slots`` is a power of two, at most 4096.

    An element's permutation walks the slots from its own start with its own odd
    stride. An empty set's row is all ones.
    """
    least = np.full(len(sets) * slots, _NONE, dtype=np.uint64)
    if sets:
        x = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        start = mix(x ^ np.uint64(0x5851F42D4C957F2D))
        stride = mix(x ^ np.uint64(0x14057B7EF767814F)) | np.uint64(1)
        for step in range(slots):
            if not len(x):
                break
            slot = ((start + np.uint64(step) * stride) & np.uint64(slots - 1)).astype(np.int64)
            offer = mix(x + np.uint64((step + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12) | np.uint64(step << 52)
            np.minimum.at(least, row * slots + slot, offer)
            open_rows = (least.reshape(-1, slots) == _NONE).any(axis=1)
            go_on = open_rows[row]
            if not go_on.all():
                x, row, start, stride = x[go_on], row[go_on], start[go_on], stride[go_on]
    return least.reshape(-1, slots)


def in_portions(sets: Iterator[np.ndarray], elements: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Lists of sets with about so many elements each."""
    portion, n = [], 0
    for s in sets:
        portion.append(s)
        n += len(s)
        if n >= elements:
            yield portion
            portion, n = [], 0
    if portion:
        yield portion


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)

"""Periodic runs of words in a document, by seeds that are extended along diagonals.

A run of period q is a stretch in which words q apart are identical, so it is a
diagonal of matches (i, i + q). Diagonals are looked for by octaves of lags: those
of lag 1 to 11 match in 6 places at least, those of lag 6 * 2^t and more in 6 * 2^t.
Any such stretch of M places holds a whole gram of M / 2 words that starts at one of
every (M / 2 + 1)-th place. Grams of that length are indexed, and each of these places
looks up where its own gram stands again at a lag of the octave. That makes at most
about two pairs a word and octave, whatever the text.

Each pair is extended both ways, unless the table of its lag says that the diagonal
has been followed past that place. Grams are numbered by doubling, so equal numbers
are equal words, and how far two places agree is found in steps of falling powers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from perfmine.llm.common import arrow_map, id_and_text

LEAST_LENGTH = 12
#: A run has its period twice, so it matches itself in this many places whatever its period.
LEAST_OVERLAP = LEAST_LENGTH // 2
#: Words that are worked on at once; a longer document is worked on alone.
PORTION_WORDS = 400_000


def repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A number for each of ``n`` places: equal ``keys`` (of the places ``at``) share one from 0 up, all else is unlike any other."""
    numbers = -1 - np.arange(n, dtype=np.int64)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    numbers[at[again]] = which[again]
    return numbers


def joined(first: np.ndarray, second: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the grams of ``first`` (``length`` words) followed by those of ``second``."""
    n = len(first)
    at = np.flatnonzero((first[: max(n - length, 0)] >= 0) & (second[length:] >= 0))
    return repeated(first[at] * np.int64(n + 1) + second[at + length], at, n)


def gram_levels(words: np.ndarray, document: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, numbers) of grams of 1, 3, 6, 12, ... words, as long as any gram stands twice in its document.

    Numbers belong to one document. One place past the end is added, unlike any other.
    """
    ones = repeated(document * np.int64(words.max(initial=0) + 1) + words, np.arange(len(words)), len(words))
    threes = joined(joined(ones, ones, 1), ones, 2)
    levels, length = [(1, ones)], 3
    while (threes >= 0).any():
        levels.append((length, threes))
        threes, length = joined(threes, threes, length), 2 * length
    return [(k, np.append(numbers, -1 - len(words))) for k, numbers in levels]


def agreement(levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from ``i`` and ``j`` on, and before them, are the same."""
    end = len(levels[0][1]) - 1
    ahead, behind = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    for length, numbers in reversed(levels):
        open_ = np.arange(len(i))
        while len(open_):
            same = numbers[np.minimum(i[open_] + ahead[open_], end)] == numbers[np.minimum(j[open_] + ahead[open_], end)]
            open_ = open_[same]
            ahead[open_] += length
        open_ = np.arange(len(i))
        while len(open_):
            left = i[open_] - behind[open_] - length
            same = (left >= 0) & (numbers[np.maximum(left, 0)] == numbers[np.maximum(j[open_] - behind[open_] - length, 0)])
            open_ = open_[same]
            behind[open_] += length
    return ahead, behind


def seeds(numbers: np.ndarray, start: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with the same gram, ``low`` to ``high - 1`` apart, the first at every ``step``-th place of its document."""
    n = len(numbers)
    at = np.flatnonzero(numbers[:-1] >= 0)
    index = np.sort(numbers[at] * n + at)
    ask = at[(at - start[at]) % step == 0]
    base = numbers[ask] * n
    first = np.searchsorted(index, base + np.minimum(ask + low, n - 1))
    last = np.searchsorted(index, base + np.minimum(ask + high, n - 1))
    found = np.maximum(last - first, 0)
    i = np.repeat(ask, found)
    j = index[np.repeat(first, found) + np.arange(len(i)) - np.repeat(np.cumsum(found) - found, found)] % n
    return i, j


def diagonals(levels: list[tuple[int, np.ndarray]], document: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, end, lag) of the diagonals that the pairs (i, j) lie on, each followed once."""
    if not len(i):
        return
    n = np.int64(len(document) + 1)
    of_lag, pair = np.unique(document[i] * n + (j - i), return_inverse=True)
    keys = np.unique(pair * n + i)
    # per document and lag: the next pair that no diagonal has covered
    lane = np.arange(len(of_lag))
    ends = np.searchsorted(keys, (lane + 1) * n)
    following = np.searchsorted(keys, lane * n)
    while len(lane):
        at, lag = keys[following] % n, of_lag[lane] % n
        ahead, behind = agreement(levels, at, at + lag)
        yield at - behind, at + ahead + lag, lag
        following = np.searchsorted(keys, lane * n + at + ahead)
        go_on = following < ends[lane]
        lane, following = lane[go_on], following[go_on]


def runs_of(words: np.ndarray, document: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of the documents that lie one after another in ``words``, by start, then period.

    ``document`` numbers each word's document, ``start`` is where that begins.
    """
    found = [np.zeros((0, 3), dtype=np.int64)]
    levels = gram_levels(words, document)
    low, high, overlap = 1, LEAST_LENGTH, LEAST_OVERLAP
    for length, numbers in levels[1:]:
        # a gram of half the overlap, from every place that makes sure of one whole gram in it
        for s, e, q in diagonals(levels, document, *seeds(numbers, start, overlap - length + 1, low, high)):
            fits = e - s >= np.maximum(LEAST_LENGTH, 2 * q)
            found.append(np.stack([s[fits], e[fits], q[fits]], axis=1))
        overlap *= 2
        low, high = overlap, 2 * overlap
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a stretch belongs to its smallest period; all its others are multiples
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)][: len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; ``runs`` is an array of (start, length, period).

    Words end at ASCII white space and are numbered from 0. A run is a stretch of
    words with smallest period q, at least max(12, 2 q) long, that no neighbouring
    word extends. Runs are in order of start, then period. ``collapsed`` is the
    text, its words joined by blanks, without the words that stand in any run
    after that run's first period. Null, empty and blank texts have no words and
    no runs. Repeated rows are answered each for itself, a null id is kept.
    ``rewrite`` may change the words of a document before anything else.

    A document is worked on whole, in time and memory that grow with n log n.
    """

    def answers(portion: list[tuple[int | None, list[bytes]]]) -> dict:
        numbers = defaultdict(count().__next__)
        lengths = [len(w) for _, w in portion]
        words = np.fromiter((numbers[w] for _, ws in portion for w in ws), dtype=np.int64, count=sum(lengths))
        starts = np.cumsum([0, *lengths])
        runs = runs_of(words, np.repeat(np.arange(len(portion)), lengths), np.repeat(starts[:-1], lengths))
        dropped = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 1], -1)
        dropped = np.cumsum(dropped) > 0
        cuts = np.searchsorted(runs[:, 0], starts)
        collapsed = []
        for k, (_, ws) in enumerate(portion):
            if cuts[k] < cuts[k + 1]:
                gone = dropped[starts[k] : starts[k + 1]]
                ws = [w for w, g in zip(ws, gone, strict=True) if not g]
            collapsed.append(b" ".join(ws))
        base = np.repeat(starts[:-1], np.diff(cuts))
        items = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - base, runs[:, 1] - runs[:, 0], runs[:, 2])], ["start", "length", "period"])
        return {
            "doc_id": [i for i, _ in portion],
            "n_words": lengths,
            "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        portion, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().split()
                if rewrite:
                    words = rewrite(doc_id, words)
                if portion and size + len(words) > PORTION_WORDS:
                    yield answers(portion)
                    portion, size = [], 0
                portion.append((doc_id, words))
                size += len(words)
        if portion:
            yield answers(portion)

    return arrow_map(
        id_and_text(docs, id_col, text_col), work, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )

"""Benchmark decontamination by a BM25 index of the test items.

Every passage of a training text is a query. An item's question is also indexed on
its own. The score of either is divided by the score that it reaches with itself,
so one threshold holds for all, but for those of which a repetition that passes
verification could score less: they have that least score as their bar.
Items lie in blocks, and for each term the index has the largest contribution to
any item of a block. The sum of these over a passage's terms bounds the scores of
the block's items: only blocks whose bound reaches their lowest bar are scored.
Retrieved items are verified by the overlap of their question and their answer
with the text around the passage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text, staged
from perfmine.llm.words import folded_words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.75
SHINGLE = 5
#: Fewer shingles, those of eight words, do not make a question that can be told from ordinary text.
LEAST_QUESTION = 4
#: An index holds items of about so many characters, questions counted again; more items make more indexes.
INDEX_CHARS = 4_000_000
BLOCKS, LEAST_BLOCK = 128, 2
#: Longer items enter the index in parts of so many words.
PART = 200


class Terms(dict):
    """Word -> term number from 1; 0 for words of no item."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    asking: list[bytes] = field(default_factory=list)  # the words of the question
    whole: set = field(default_factory=set)  # with the shingles that run from the question into the answer
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)


def shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def make_item(item_id: int, text: str) -> Item:
    """The answer is the last sentence, or the last third if that has fewer than five words or is all there is."""
    words = folded_words(text)
    last = folded_words(re.split(r"[.?!]\s+", text.strip())[-1])
    n = len(last) if SHINGLE <= len(last) < len(words) else max(SHINGLE, len(words) // 3)
    cut = max(0, len(words) - n)
    return Item(item_id, words, words[:cut], shingles(words), shingles(words[:cut]), shingles(words[cut:]))


@dataclass
class Part:
    """Words of an item or of its question, and which shingles start in it: 1 the first time, 0 if they came before."""

    owner: int
    words: list[bytes]
    new: list[int]

    @property
    def counts(self) -> Counter:
        return Counter(self.words)


def parts_of(owner: int, words: list[bytes]) -> list[Part]:
    seen: set[bytes] = set()
    new = []
    for i in range(len(words) - SHINGLE + 1):
        shingle = b" ".join(words[i : i + SHINGLE])
        new.append(int(shingle not in seen))
        seen.add(shingle)
    return [Part(owner, words[at : at + PART], new[at : at + PART]) for at in range(0, len(words), PART)]


def bars(parts: list[Part], scores: list[dict], at_once: int = 256) -> np.ndarray:
    """The score from which each part is retrieved: THRESHOLD, or less if a repetition that passes can score less.

    Of a text that has 75 % of the shingles, some part has 75 % of those that
    start in it. What it can lack is the most weight of words all of whose
    shingles are among the other 25 %, found shingle by shingle for every number
    left out and every number left out in a row. A word counts where it is first.
    """
    out = np.full(len(parts), THRESHOLD)
    for low in range(0, len(parts), at_once):
        some = parts[low : low + at_once]
        n = np.array([len(p.new) for p in some])
        allowed = np.array([int((1 - OVERLAP) * sum(p.new) + 1e-9) for p in some])
        weight = np.zeros((len(some), max(n) + SHINGLE))
        cost = np.zeros((len(some), max(n)), dtype=bool)
        for k, p in enumerate(some):
            left = dict(scores[low + k])
            weight[k, : len(p.words)] = [left.pop(w, 0.0) for w in p.words][: weight.shape[1]]
            cost[k, : len(p.new)] = p.new
        lost = np.full((len(some), SHINGLE + 1, allowed.max() + 1), -np.inf)
        lost[:, SHINGLE, 0] = 0  # nothing before the first word holds it
        for i in range(max(n)):
            moved = np.full_like(lost, -np.inf)
            moved[:, :, 1:] = lost[:, :, :-1]
            moved = np.where(cost[:, i, None, None], moved, lost)
            after = np.empty_like(lost)
            after[:, 0] = lost.max(axis=1)
            after[:, 1:] = moved[:, :-1]
            after[:, SHINGLE] = np.maximum(moved[:, SHINGLE - 1], moved[:, SHINGLE]) + weight[:, i, None]
            lost = np.where((i < n)[:, None, None], after, lost)
        tail = np.zeros((len(some), SHINGLE + 1, 1))
        for k in range(1, SHINGLE):
            tail[:, SHINGLE - k :, 0] += weight[np.arange(len(some)), np.maximum(n, 1) - 1 + k][:, None]
        lost = (lost + tail).max(axis=1)
        lost[np.arange(lost.shape[1]) > allowed[:, None]] = 0
        least = np.maximum(1 - lost.max(axis=1) - 1e-6, 1e-9)
        out[low : low + at_once] = np.where([sum(p.new) > 0 for p in some], np.minimum(THRESHOLD, least), THRESHOLD)
    return out


@dataclass
class Statistics:
    """What BM25 needs to know of all items together, whichever index they are in."""

    df: dict[bytes, int]  # parts of items with the word
    wholes: int  # parts of items
    words: int
    stride: int

    @staticmethod
    def of(items: list[Item]) -> Statistics:
        parts = [p for k, i in enumerate(items) for p in parts_of(k, i.words)]
        df = Counter(w for p in parts for w in p.counts)
        return Statistics(df, len(parts), sum(len(p.words) for p in parts), max((min(PART, len(i.words)) for i in items), default=1))


@dataclass
class Index:
    """BM25 postings of item parts, in blocks."""

    items: list[Item]
    terms: Terms
    owner: np.ndarray  # item of a part
    bar: np.ndarray  # least score of a part
    block_bar: np.ndarray  # the lowest bar of the block
    block_max: np.ndarray  # terms x blocks: the largest contribution to a part of the block
    row: np.ndarray  # terms x blocks: where the term's postings lie in the block's table, 0 if it has none
    blocks: list[np.ndarray]  # per block: rows x parts, contributions
    stride: int

    @staticmethod
    def build(items: list[Item], known: Statistics | None = None) -> Index:
        """An index of ``items``; ``known`` are the statistics of all items if these are some of them."""
        known = known or Statistics.of(items)
        df, wholes, mean = known.df, known.wholes, known.words / max(1, known.wholes)
        parts = [p for k, i in enumerate(items) for p in parts_of(k, i.words)]
        terms = Terms({w: n + 1 for n, w in enumerate(sorted({w for p in parts for w in p.words}))})
        own_wholes = len(parts)
        # questions are scored with the statistics of the whole items
        parts += [p for k, i in enumerate(items) if len(i.question) >= LEAST_QUESTION for p in parts_of(k, i.asking)]
        scores = []
        for p in parts:
            norm = K1 * (1 - B + B * len(p.words) / mean)
            score = {w: np.log1p((wholes - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in p.counts.items()}
            total = sum(score.values())
            scores.append({w: x / total for w, x in score.items()})
        bar = bars(parts, scores)
        per_block = max(LEAST_BLOCK, -(-own_wholes // BLOCKS))
        n_blocks = -(-len(parts) // per_block)
        block_max = np.zeros((len(terms) + 1, n_blocks), dtype=np.float32)
        row = np.zeros((len(terms) + 1, n_blocks), dtype=np.int32)
        blocks = []
        for b in range(n_blocks):
            own = scores[b * per_block : (b + 1) * per_block]
            used = sorted({terms[w] for score in own for w in score})
            row[used, b] = np.arange(1, len(used) + 1)
            block = np.zeros((len(used) + 1, len(own)))
            for p, score in enumerate(own):
                for w, x in score.items():
                    block[row[terms[w], b], p] = x
            # rounded up, so that the bound stays one
            block_max[used, b] = block[1:].max(axis=1) * 1.00001
            blocks.append(block)
        block_bar = np.array([bar[b * per_block : (b + 1) * per_block].min() for b in range(n_blocks)])
        return Index(items, terms, np.array([p.owner for p in parts], dtype=np.int64), bar, block_bar, block_max, row, blocks, known.stride)

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(item, first word, score) of every passage and part of an item that reaches its bar.

        A passage is two strides long and the next one starts a stride later, so
        every part of an item that a text repeats lies whole in some passage.
        """
        ids = np.fromiter(map(self.terms.__getitem__, words), dtype=np.int64, count=len(words))
        width = len(self.block_max)
        known = np.flatnonzero(ids)
        if not len(known):
            return
        keys = np.unique(known // self.stride * width + ids[known])
        segment, term = np.divmod(keys, width)
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        bounds = np.zeros((int(segment[-1]) + 3, self.block_max.shape[1]), dtype=np.float32)
        bounds[segment[first] + 1] = np.add.reduceat(self.block_max[term], first, axis=0)
        terms_of: dict[int, np.ndarray] = {}
        # row s of the bounds is segment s - 1; passage s has segments s - 1 and s
        for s, b in np.argwhere(bounds[:-1] + bounds[1:] >= self.block_bar).tolist():
            if s not in terms_of:
                low, high = np.searchsorted(segment, (s - 1, s + 1))
                terms_of[s] = np.unique(term[low:high])
            # the last digits follow the order of summation, which is not that of another index
            score = self.blocks[b][self.row[terms_of[s], b]].sum(axis=0).round(9)
            at = b * self.blocks[0].shape[1]
            for p in np.flatnonzero(score >= self.bar[at : at + len(score)]).tolist():
                part = at + p
                yield int(self.owner[part]), max(0, s - 1) * self.stride, float(score[p])

    def leaks(self, text: str) -> list[dict]:
        """The verified items of one text, each with its best passage."""
        words = folded_words(text)
        found: dict[int, dict] = {}
        best: dict[tuple[int, int], float] = {}
        for k, start, score in self.passages(words):
            best[k, start] = max(score, best.get((k, start), 0.0))
        for (k, start), score in best.items():
            item = self.items[k]
            around = shingles(words[max(0, start - len(item.words)) : start + 2 * self.stride + len(item.words)])
            whole = len(item.whole & around) / len(item.whole)
            asked = len(item.question & around) / len(item.question) if item.question else whole
            if whole >= OVERLAP or (len(item.question) >= LEAST_QUESTION and asked >= OVERLAP):
                row = {
                    "item_id": item.item_id,
                    "first_word": start,
                    "score": score,
                    "item_overlap": whole,
                    "question_overlap": asked,
                    "answer_overlap": len(item.answer & around) / len(item.answer),
                }
                if k not in found or (whole, score, -start) > (found[k]["item_overlap"], found[k]["score"], -found[k]["first_word"]):
                    found[k] = row
        return [found[k] for k in sorted(found)]


_LEAK = "doc_id long, item_id long, first_word long, score double, item_overlap double, question_overlap double, answer_overlap double"


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item that the document repeats.

    (doc_id, item_id, first_word, score, item_overlap, question_overlap,
    answer_overlap) of the best passage; ``first_word`` is the word number where
    it starts, ``score`` the better of the item's and its question's, or of their
    parts'. An item is repeated if 75 % of its five-word shingles, or of its
    question's, stand around a passage that BM25 retrieves; a passage that has
    them itself always is. Words are compared
    without case and punctuation. Items of fewer than five words are passed over,
    as are null texts; rows of documents that repeat are reported each, a null id
    is kept. Equal items under several ids are all reported; one row of an item
    id with several texts is reported per text.

    The index is broadcast. Its size is bounded by ``INDEX_CHARS``: a larger
    benchmark is searched in several indexes, one pass each.
    """
    docs = id_and_text(docs, id_col, text_col)
    parts = [arrow_map(docs, _searching(index), _LEAK) for index in indexes_of(benchmark)]
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that repeat no item, null texts included; the rows stay where they are."""
    for index in indexes_of(benchmark):
        docs = docs.where(_clean(index)(F.col(text_col).cast("string")))
    return docs


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.value.leaks(t or "") for t in texts], dtype=bool)

    return clean


def statistics_of(tests: DataFrame, parts: int) -> list[Statistics]:
    """The statistics of all items, for each of ``parts`` indexes with the words of its own items only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = make_item(0, text)
                if len(item.words) >= SHINGLE:
                    known = Statistics.of([item])
                    # the sums of an item stand in a row without a word
                    rows.append((number, None, 0, known.wholes, known.words, known.stride))
                    rows += [(number, w, n, 0, 0, 0) for w, n in known.df.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield dict(zip(("index", "word", "df", "wholes", "words", "stride"), map(list, columns), strict=True))

    rows = staged(arrow_map(tests.select("index", "text"), work, "index int, word binary, df long, wholes long, words long, stride long"), "benchmark-words")
    wholes, words, stride = rows.agg(F.sum("wholes"), F.sum("words"), F.max("stride")).first()
    df = rows.where("word is not null").groupBy("word").agg(F.sum("df").alias("df"))
    out = []
    for number in range(parts):
        own = rows.where((F.col("index") == number) & F.col("word").isNotNull()).select("word").distinct().join(df, "word")
        out.append(Statistics({bytes(r["word"]): r["df"] for r in own.toLocalIterator()}, wholes or 0, words or 0, stride or 1))
    return out


def indexes_of(benchmark: DataFrame) -> list:
    """Broadcast indexes that together hold all items of (item_id, text).

    A benchmark beyond ``INDEX_CHARS`` is dealt over several indexes, which all use
    the statistics of the whole benchmark: how it is dealt changes no result.
    """
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-2 * chars // INDEX_CHARS))
    dealt = tests.withColumn("index", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    known = statistics_of(dealt, parts) if parts > 1 else [None]
    indexes = []
    for number in range(parts):
        mine = dealt.where(F.col("index") == number).orderBy("item_id", "text")
        items = [i for i in (make_item(r.item_id, r.text) for r in mine.collect()) if len(i.words) >= SHINGLE]
        indexes.append(spark.sparkContext.broadcast(Index.build(items, known[number])))
    return indexes


def _searching(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = shared.value
        names = [x.split()[0] for x in _LEAK.split(", ")]
        for batch in batches:
            rows = [
                {"doc_id": d, **leak} for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for leak in index.leaks(t.as_py())
            ]
            yield {n: [r[n] for r in rows] for n in names}

    return work

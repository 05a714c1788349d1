"""Collocations: phrases of words by multikey quicksort of suffix pointers.

A suffix is a place in a piece of text with the two words that follow it. Each
portion of the text sorts its own suffixes and sends equal ones once, with their
number. They are routed by their leading words to parts of bounded size, and each
part is sorted by three-way partitioning, word by word, down to ``DEPTH`` words: the
weight of the partition that equals the pivot is the count of a phrase. A partition
that weighs less than ``LEAST`` holds no phrase and is abandoned.

Words that are rare in all documents end a suffix before it is sent. A leading word
that is very frequent is not routed as a whole: its suffixes of two words go by both
words, those of three by all three.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, staged

LEAST, DEPTH, TOP = 10, 3, 2000
#: A candidate goes if a longer one that holds it has this share of its count.
INSIDE_PERCENT = 50
SCALE = 1_000_000
#: Words of a portion, suffixes of a part on average, and the fewest parts.
PORTION_WORDS, PART_SUFFIXES, LEAST_PARTS = 1_500_000, 1_000_000, 32
#: Parts whose rows a portion sends at once.
BATCH_PARTS = 256
#: A word with more than one in so many places is very frequent, so there are fewer such words.
FREQUENT_SHARE = 4096
#: Bits of the bitmap of words that are not rare: four megabytes.
FILTER_BITS = 1 << 25
#: Partitions of so few suffixes are not parted further; all of them are finished by one sort.
SMALL = 5000
#: Slices of a language that are cut to its first phrases before they meet.
SLICES = 32

# fixed values: what ends a piece, and what separates words
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A word that no text has: it stands where a piece ends.
END = b"."
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + END * len(_ENDS))


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text, A-Z folded, and ``END`` between pieces."""
    return text.translate(_FOLD).replace(END, b" . ").split()


def bit_of(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\t" + word) % FILTER_BITS


def texts_by_lang(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def counted_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word."""

    def emit(counts: dict[str, Counter]) -> dict:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
        lang, word, n = zip(*rows, strict=True)
        return {"lang": list(lang), "phrase": pa.array(word, pa.binary()).cast(pa.string()), "f": list(n)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, held = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().translate(_FOLD).replace(END, b" ").split()
                counts[lang].update(words)
                held += len(words)
                if held >= PORTION_WORDS:
                    yield emit(counts)
                    counts, held = defaultdict(Counter), 0
        if held:
            yield emit(counts)

    return arrow_map(texts, work, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bitmap_of(words: DataFrame) -> np.ndarray:
    """A bitmap with the bits of all rows of ``words`` (lang, phrase) set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at = [bit_of(lang, word.as_py()) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)]
            yield {"at": at}

    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    rows = arrow_map(words.select("lang", "phrase"), work, "at long").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bitmap.view(np.uint64)


def numbered_anew(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``ids`` other than 0, rising, and ``ids`` as places among them from 1 on; all are below ``size``.

    Few numbers are sorted, so that the time for them does not depend on ``size``.
    """
    if 8 * ids.size < size:
        used, local = np.unique(ids, return_inverse=True)
        # 0 stays 0
        local = local.reshape(ids.shape)
        return (used[1:], local) if used[0] == 0 else (used, local + 1)
    marked = np.zeros(size, dtype=np.int32)
    marked[ids.ravel()] = 1
    marked[0] = 0
    return np.flatnonzero(marked), np.cumsum(marked, dtype=np.int32)[ids] * (ids > 0)


def routed(texts: DataFrame, common: np.ndarray, frequent: set[tuple[str, str]], parts: int) -> DataFrame:
    """Suffixes of all texts: (part, lang, vocabulary, ids, n), each portion's equal ones once.

    ``ids`` has ``DEPTH`` numbers of words of ``vocabulary`` per suffix, 0 for none, and
    ``n`` its number of places. Suffixes that count for their first two words only have
    a negative n where three words are sent elsewhere (see the module's text).
    """
    spark = texts.sparkSession
    shared, heads = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(frozenset((lang, w.encode()) for lang, w in frequent))

    def emit(lang: str, vocabulary: dict[bytes, int], stream: list[int]) -> Iterator[dict]:
        words = list(vocabulary)[1:]
        if not words:
            return
        prefix, digest = lang.encode() + b"\t", xxhash.xxh3_64_intdigest
        numbers = np.array([digest(prefix + w) for w in words], dtype=np.uint64)
        at = (numbers % np.uint64(FILTER_BITS)).astype(np.int64)
        usual = np.flatnonzero(shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
        # only words that are not rare keep a number
        anew = np.zeros(len(words) + 1, dtype=np.int64)
        anew[usual + 1] = np.arange(1, len(usual) + 1)
        numbers = np.concatenate([np.zeros(1, dtype=np.uint64), numbers[usual]])
        head = np.zeros(len(usual) + 1, dtype=bool)
        head[[anew[vocabulary[w]] for name, w in heads.value if name == lang and w in vocabulary]] = True
        head[0] = False
        words = [words[u] for u in usual.tolist()]
        first = anew[np.array(stream + [0] * DEPTH, dtype=np.int64)]
        n = len(stream)
        suffixes = np.stack([first[k : n + k] for k in range(DEPTH)], axis=1)
        suffixes[suffixes[:, 1] == 0, 2] = 0
        suffixes = suffixes[(suffixes[:, 0] > 0) & (suffixes[:, 1] > 0)]
        split = head[suffixes[:, 0]]
        pairs = suffixes[split].copy()
        pairs[:, 2] = 0
        all_ids, all_places, all_parts = [], [], []
        for chosen, depth, sign in ((suffixes[~split], 2, 1), (pairs, 2, 1), (suffixes[split & (suffixes[:, 2] > 0)], 3, -1)):
            key = (chosen[:, 0] << 42) | (chosen[:, 1] << 21) | chosen[:, 2]
            key, places = np.unique(key, return_counts=True)
            ids = np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], axis=1)
            route = np.full(len(ids), digest(lang.encode()), dtype=np.uint64)
            for k in range(depth):
                route = (route ^ numbers[ids[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
                route ^= route >> np.uint64(29)
            all_ids.append(ids)
            all_places.append(sign * places)
            all_parts.append((route % np.uint64(parts)).astype(np.int64))
        part = np.concatenate(all_parts)
        order = np.argsort(part, kind="stable")
        part, ids, places = part[order], np.concatenate(all_ids)[order], np.concatenate(all_places).astype("<i4")[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        ends = [*starts[1:], len(part)]
        for k in range(0, len(starts), BATCH_PARTS):
            rows = {"part": [], "lang": [], "vocabulary": [], "ids": [], "n": []}
            for a, b in zip(starts[k : k + BATCH_PARTS], ends[k : k + BATCH_PARTS], strict=True):
                used, local = numbered_anew(ids[a:b], len(words) + 1)
                rows["part"].append(int(part[a]))
                rows["lang"].append(lang)
                rows["vocabulary"].append(b"\n".join([words[u - 1] for u in used.tolist()]))
                rows["ids"].append(local.astype("<i4").tobytes())
                rows["n"].append(places[a:b].tobytes())
            yield rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def fresh() -> tuple[dict, list]:
            vocabulary = defaultdict(count(1).__next__)
            vocabulary[END] = 0
            return vocabulary, []

        portions, held = defaultdict(fresh), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                vocabulary, stream = portions[lang]
                before = len(stream)
                stream.extend(map(vocabulary.__getitem__, words_and_ends(text.as_py())))
                stream.append(0)
                held += len(stream) - before
                if held >= PORTION_WORDS:
                    for name, portion in portions.items():
                        yield from emit(name, *portion)
                    portions.clear()
                    held = 0
        for name, portion in portions.items():
            yield from emit(name, *portion)

    return arrow_map(texts, work, "part int, lang string, vocabulary binary, ids binary, n binary")


def sorted_counts(ids: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(prefixes, weights) of all prefixes of the rows of ``ids`` with ``least`` weight or more; 0 ends a row.

    Multikey quicksort: each step parts suffixes into those with a smaller, the same
    and a larger word than the pivot at their depth; small partitions are sorted at
    the end, all together. Prefixes come in rows as wide as those of ``ids``.
    """
    small = []
    open_ = [(np.flatnonzero(ids[:, 0] > 0), 0)]
    while open_:
        at, depth = open_.pop()
        if len(at) <= SMALL:
            # the words before this depth are counted where the partition came from
            small.append((at, depth))
            continue
        word = ids[at, depth]
        pivot = word[len(word) // 2] if len(word) < 1000 else np.partition(word[:: len(word) // 101], 50)[50]
        for side in (word < pivot, word > pivot):
            part = at[side]
            if weights[part].sum() >= least:
                open_.append((part, depth))
        equal = at[word == pivot]
        weight = weights[equal].sum()
        if weight >= least:
            prefix = np.zeros((1, ids.shape[1]), dtype=ids.dtype)
            prefix[0, : depth + 1] = ids[equal[0], : depth + 1]
            yield prefix, np.array([weight])
            if depth + 1 < ids.shape[1]:
                equal = equal[ids[equal, depth + 1] > 0]
                if weights[equal].sum() >= least:
                    open_.append((equal, depth + 1))
    for depth in range(ids.shape[1]):
        at = np.concatenate([np.zeros(0, dtype=np.int64), *(p for p, d in small if d == depth)])
        at = at[np.lexsort(ids[at].T[::-1])]
        for k in range(depth, ids.shape[1]):
            at = at[ids[at, k] > 0]
            if not len(at):
                break
            rows = ids[at, : k + 1]
            heads = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
            weight = np.add.reduceat(weights[at], heads)
            prefix = np.zeros((len(heads), ids.shape[1]), dtype=ids.dtype)
            prefix[:, : k + 1] = rows[heads]
            yield prefix[weight >= least], weight[weight >= least]


def counted_phrases(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, f) of the phrases of two words and more with f at least ``least``."""

    def settle(part: pa.Table) -> pa.Table:
        out = {"lang": [], "phrase": [], "size": [], "f": []}
        langs = np.array(part["lang"].to_pylist())
        for lang in sorted(set(langs)):
            vocabulary = defaultdict(count(1).__next__)
            all_ids, all_n = [], []
            for k in np.flatnonzero(langs == lang):
                known = np.array([0, *map(vocabulary.__getitem__, part["vocabulary"][k].as_py().split(b"\n"))], dtype=np.int64)
                all_ids.append(known[np.frombuffer(part["ids"][k].as_py(), "<i4").reshape(-1, DEPTH)].astype(np.int32))
                all_n.append(np.frombuffer(part["n"][k].as_py(), "<i4").astype(np.int64))
            ids, n = np.concatenate(all_ids), np.concatenate(all_n)
            words = [b"", *vocabulary]
            # the two words of a negative weight are counted elsewhere
            for rows, sizes in ((n > 0, (2, 3)), (n < 0, (3,))):
                for prefixes, counts in sorted_counts(ids[rows], abs(n[rows]), least):
                    size = (prefixes > 0).sum(axis=1)
                    fits = np.isin(size, sizes)
                    out["lang"] += [lang] * int(fits.sum())
                    out["phrase"] += [b" ".join([words[i] for i in row if i]) for row in prefixes[fits].tolist()]
                    out["size"] += size[fits].tolist()
                    out["f"] += counts[fits].tolist()
        return pa.table(
            [pa.array(out["lang"], pa.string()), pa.array(out["phrase"], pa.binary()).cast(pa.string()), pa.array(out["size"], pa.int32()), pa.array(out["f"], pa.int64())],
            names=list(out),
        )

    return suffixes.groupBy("part").applyInArrow(settle, "lang string, phrase string, size int, f long")


def looked_up(df: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """``df`` with the count ``name`` of the phrase in column ``key``.

    The phrases that very many rows may ask for are few and sent to all; rows that
    have found theirs are dealt out at large for the other join.
    """
    top = F.broadcast(counts.where("frequent").select("lang", F.col("phrase").alias(key), F.col("f").alias("_top")))
    rest = counts.where("not frequent").select("lang", F.col("phrase").alias("_key"), F.col("f").alias("_rest"))
    # no phrase holds a line break
    asked = df.join(top, ["lang", key], "left").withColumn("_key", F.when(F.col("_top").isNull(), F.col(key)).otherwise(F.concat(F.lit("\n"), "phrase")))
    return asked.join(rest, ["lang", "_key"], "left").withColumn(name, F.coalesce("_top", "_rest")).drop("_top", "_rest", "_key")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    Texts are cut into pieces at ``. , ; : ! ?`` and line breaks, pieces into words at
    blanks and tabs, A-Z folded. a, l and r are the places of the phrase, of its
    first part and of the rest, n the words of the language. The score is
    floor(1000000 a a / (l r)) for the cut with the lowest, the first of equal ones.
    Phrases with a < ``least`` are no candidates; a candidate inside a longer one
    that has half its count goes. Ties go by a, then by the phrase in byte order.

    A null text is empty, a null language is ``und``. Every row counts, repeated
    ones too; an empty table has no phrases.
    """
    if least < 1:
        raise ValueError("a phrase has one place at least")
    texts = texts_by_lang(docs, text_col, lang_col)
    words = staged(counted_words(texts), "words")
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("f") * FREQUENT_SHARE > F.lit(total)
    usual = words.where(F.col("f") >= least)
    heads = {(r["lang"], r["phrase"]) for r in usual.where(frequent).select("lang", "phrase").collect()}

    suffixes = routed(texts, bitmap_of(usual), heads, max(LEAST_PARTS, total // PART_SUFFIXES))
    phrases = staged(counted_phrases(suffixes, least), "phrases")

    one = usual.select("lang", "phrase", "f", frequent.alias("frequent"))
    two = phrases.where("size = 2").select("lang", "phrase", "f", frequent.alias("frequent"))
    part = F.split("phrase", " ")

    def words_from(start: int, size: int) -> F.Column:
        return F.array_join(F.slice(part, start, size), " ")

    def lowest(size: int) -> DataFrame:
        df = phrases.where(F.col("size") == size).select("lang", "phrase", F.col("f").alias("a"))
        cuts = []
        for k in range(1, size):
            sides = {"l": (words_from(1, k), k), "r": (words_from(k + 1, size - k), size - k)}
            for side, (text, length) in sides.items():
                df = looked_up(df.withColumn("_side", text), "_side", one if length == 1 else two, f"{side}{k}").drop("_side")
            score = F.expr(f"{SCALE} * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        return df.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("cut"))

    triples = phrases.where("size = 3")
    inside = (
        triples.select("lang", "f", F.explode(F.array(words_from(1, 2), words_from(2, 2))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    pairs = lowest(2).join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < INSIDE_PERCENT * F.col("a"), F.lit(True))).drop("longer")
    kept = pairs.unionByName(lowest(3)).select("lang", "phrase", "a", "cut.*")
    first = (F.desc("score"), F.desc("a"), "phrase")
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    for keys in (("lang", "slice"), ("lang",)):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where(F.col("rank") <= top)
    ranked = sliced
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Removal of repeated byte strings: difference-cover sample, then blocks of suffixes.

A string of ``LENGTH`` bytes is repeated if two suffixes agree that far, so suffixes
need no order beyond that depth, and a suffix's place among the others is told by
the name of its first bytes (80 bits of a hash). Suffixes are never all written:

* The cover. Places of a document are sampled by a difference cover D modulo v: for
  any two places i and j there is a shift below v that puts both into the sample.
  So, where two suffixes agree in LENGTH bytes, two sampled ones not more than v - 1
  further agree in LENGTH - v + 1. Sampled suffixes are ranked by that many bytes.
* Ties. Only a suffix before a tied sampled suffix, less than v bytes away, can be
  repeated; all others are settled by the sample. What surrounds a tied sampled
  suffix is ranked by ``SIDES`` strings around it, each of which all suffixes of one
  stretch before it have in common. Only stretches of tied strings are left.
* Blocks. The suffixes of these stretches are named by all their LENGTH bytes and
  ranked in turn.

All steps deal names into blocks small enough for a task, and one block is sorted
at a time. A portion of the text sends each of its names once, however often it has
it, so a string that is everywhere makes one entry per portion and never meets in
one task as often as it stands in the text. Texts that are the same altogether take
part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text, staged

LENGTH = 400
#: Orders of the planes that give covers; v = q * q + q + 1 is prime for each.
_ORDERS = (2, 3, 5, 17, 41, 59, 71, 89, 101)
#: Places that are named before they are sorted and sent.
PORTION_PLACES = 400_000
#: Names of a block, on average, and the fewest blocks.
BLOCK_NAMES, LEAST_BLOCKS = 1_000_000, 32
#: Strings that are compared around a tied suffix of the sample.
SIDES = 4
#: Bits of the bitmap of texts that are wanted: two megabytes.
FILTER_BITS = 1 << 24
_NAMES, _TIED, _SEGMENTS = 0, 1, 2


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, D): the difference cover of the largest plane with v at most 0.8 * ``length``.

    The q + 1 numbers are the exponents i for which x^i has no square term in the
    field of q^3 elements: points of a line in a projective plane of v points, any
    two shifts of which meet in a point.
    """
    q = max((q for q in _ORDERS if 5 * (q * q + q + 1) <= 4 * length), default=None)
    if q is None:
        raise ValueError(f"no cover for strings of {length} bytes; they need 9 at least")
    # x^3 = a x + b without a root is irreducible; as v is prime, x runs through all points
    a, b = next((a, b) for a in range(q) for b in range(1, q) if all((x**3 - a * x - b) % q for x in range(q)))
    v, cover, (c0, c1, c2) = q * q + q + 1, [], (1, 0, 0)
    for i in range(v):
        if c2 == 0:
            cover.append(i)
        c0, c1, c2 = b * c2 % q, (c0 + a * c2) % q, c1
    return v, np.array(cover)


def sampled_places(n: int, depth: int, v: int, cover: np.ndarray) -> np.ndarray:
    """The places of the sample with ``depth`` bytes from them on in a text of ``n`` bytes."""
    places = (np.arange(0, n, v)[:, None] + cover).ravel()
    return places[places + depth <= n]


def names_at(text: bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """The names of the strings of ``depth`` bytes at ``places``, 128 bits in two columns."""
    view, digest = memoryview(text), xxhash.xxh3_128_digest
    parts = [
        np.frombuffer(b"".join([digest(view[p : p + depth]) for p in places[k : k + 100_000].tolist()]), dtype="<u8")
        for k in range(0, len(places), 100_000)
    ]
    return np.concatenate(parts).reshape(-1, 2) if parts else np.zeros((0, 2), dtype="<u8")


def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of names, and for each in that order whether it is unlike the one before."""
    order = np.argsort(high, kind="stable")
    h, w = high[order], low[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    if (~first[1:] & (w[1:] != w[:-1])).any():
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        first[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order, first


def packed_steps(values: np.ndarray) -> bytes:
    """Rising numbers as steps, all low halves before all high ones, which are nearly always zero."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return (steps & np.uint32(0xFFFF)).astype("<u2").tobytes() + (steps >> np.uint32(16)).astype("<u2").tobytes()


def unpacked_steps(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, dtype="<u2").astype(np.int64)
    n = len(halves) // 2
    return np.cumsum(halves[:n] + (halves[n:] << 16))


def dealt(segments: list[tuple], blocks: int, portion: int) -> Iterator[dict]:
    """The rows that one portion sends: its names by block, its own ties, and where its segments lie.

    ``segments`` are (fp, base, places, names): places of a text, from ``base`` on. A
    portion numbers its places through: each segment starts where the one before ends.
    """
    spans = [int(places[-1]) - base + 1 for _, base, places, _ in segments]
    starts = np.cumsum([0, *spans])
    offsets = np.concatenate([places - base + s for (_, base, places, _), s in zip(segments, starts, strict=False)])
    both = np.concatenate([names for *_, names in segments])
    high, low = both[:, 0], both[:, 1].astype("<u2")
    order, first = ranked(high, low)
    heads = np.flatnonzero(first)
    many = np.diff(np.append(heads, len(order))) > 1
    alone, shared = np.sort(order[heads[~many]]), order[heads[many]]
    own = np.ones(len(order), dtype=bool)
    own[alone] = False

    def by_block(at: np.ndarray) -> dict[int, np.ndarray]:
        block = (high[at] % np.uint64(blocks)).astype(np.int64)
        at, block = at[np.argsort(block, kind="stable")], np.sort(block)
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        return {int(block[c]): part for c, part in zip(cuts, np.split(at, cuts[1:]), strict=True)} if len(at) else {}

    singles, known = by_block(alone), by_block(shared)
    none = np.zeros(0, dtype=np.int64)
    rows = []
    for block in sorted({*singles, *known}):
        one, more = singles.get(block, none), known.get(block, none)
        rows.append((block, _NAMES, packed_steps(offsets[one]), high[one].tobytes() + low[one].tobytes(), high[more].tobytes() + low[more].tobytes()))
    home = portion % blocks
    rows.append((home, _TIED, packed_steps(offsets[own]), None, None))
    fps = b"".join(fp for fp, *_ in segments)
    bases = np.array([base for _, base, *_ in segments], dtype="<i8")
    rows.append((home, _SEGMENTS, starts[:-1].astype("<i8").tobytes(), fps, bases.tobytes()))
    block, kind, places, names, more = map(list, zip(*rows, strict=True))
    yield {"block": block, "portion": [portion] * len(rows), "kind": kind, "places": places, "names": names, "more": more}


def ties(texts: DataFrame, chosen: Callable[[int, object], np.ndarray], depth: int, blocks: int) -> DataFrame:
    """(fp, places): places, as four-byte numbers, whose ``depth`` bytes also stand at another chosen place.

    ``texts`` is (fp, text, hint) in a fixed order; ``chosen`` gives the places
    of a text from its length and hint. A text may have several rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task = TaskContext.get()
        portion, held, segments = (task.partitionId() if task else 0) << 32, 0, []
        for batch in batches:
            for fp, text, hint in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                fp, text = fp.as_py(), text.as_py()
                places = chosen(len(text), hint.as_py())
                while len(places):
                    part, places = np.split(places, [PORTION_PLACES - held])
                    segments.append((fp, int(part[0]), part, names_at(text, part, depth)))
                    held += len(part)
                    if held >= PORTION_PLACES:
                        yield from dealt(segments, blocks, portion)
                        portion, held, segments = portion + 1, 0, []
        if segments:
            yield from dealt(segments, blocks, portion)

    def parts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(data) // 10
        return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u2", n, 8 * n)

    def settle(block: pa.Table) -> pa.Table:
        """Sort one block; singles that are not alone in it are tied."""
        kinds = block["kind"].to_pylist()
        portions, places, names, more = (block[c] for c in ("portion", "places", "names", "more"))
        at = [k for k, kind in enumerate(kinds) if kind == _NAMES]
        out = [(portions[k].as_py(), kinds[k], places[k].as_py(), names[k].as_py(), more[k].as_py()) for k, kind in enumerate(kinds) if kind != _NAMES]
        if at:
            single = [parts(names[k].as_py()) for k in at]
            shared = [parts(more[k].as_py()) for k in at]
            high, low = (np.concatenate([p[c] for p in single + shared]) for c in (0, 1))
            order, first = ranked(high, low)
            tied = np.empty(len(order), dtype=bool)
            tied[order] = ~first | ~np.append(first[1:], True)
            # a shared name is in its portion twice already
            heads = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            is_shared = order >= sum(len(p[0]) for p in single)
            known = np.zeros(len(heads), dtype=bool)
            known[group[is_shared]] = True
            tied[order] |= known[group]
            cut = 0
            for k, (h, _) in zip(at, single, strict=True):
                hit = tied[cut : cut + len(h)]
                cut += len(h)
                if hit.any():
                    out.append((portions[k].as_py(), _TIED, packed_steps(unpacked_steps(places[k].as_py())[hit]), None, None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["portion", "kind", "places", "names", "more"])

    def placed(portion: pa.Table) -> pa.Table:
        """From numbers in a portion to places of texts."""
        rows = portion.to_pylist()
        segments = next(r for r in rows if r["kind"] == _SEGMENTS)
        starts, bases = np.frombuffer(segments["places"], "<i8"), np.frombuffer(segments["more"], "<i8")
        found = np.sort(np.concatenate([unpacked_steps(r["places"]) for r in rows if r["kind"] == _TIED]))
        owner = np.searchsorted(starts, found, side="right") - 1
        fps, places = [], []
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for part, k in zip(np.split(found, cuts[1:]), owner[cuts], strict=True) if len(found) else ():
            fps.append(segments["names"][16 * k : 16 * k + 16])
            places.append((part - starts[k] + bases[k]).astype("<u4").tobytes())
        return pa.table([pa.array(fps, pa.binary()), pa.array(places, pa.binary())], names=["fp", "places"])

    sent = arrow_map(texts, work, "block int, portion long, kind int, places binary, names binary, more binary")
    settled = sent.groupBy("block").applyInArrow(settle, "portion long, kind int, places binary, names binary, more binary")
    return settled.groupBy("portion").applyInArrow(placed, "fp binary, places binary")


def filled_bitmap(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test of ``fp`` that is true for all of ``wanted``, and for few others until the fixed bitmap fills up."""
    at = F.pmod(F.xxhash64("fp"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda fp: maybe(F.pmod(F.xxhash64(fp), F.lit(FILTER_BITS)))


def merged(found: DataFrame) -> DataFrame:
    """One row per text: the places of all its portions, in order."""
    return found.groupBy("fp").agg(F.array_join(F.array_sort(F.collect_list(F.hex("places"))), "").alias("hex")).select("fp", F.unhex("hex").alias("places"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every row.

    A byte of a text, as UTF-8, is removed if a string of ``length`` bytes covers
    it that also starts anywhere else in the table, in the same text too; strings
    are judged on the input. ``removed`` holds the maximal removed runs (start,
    end). A null text is empty. Each row is a text of its own: rows that repeat
    one another lose all of it if it has ``length`` bytes. A null id is kept.

    Two strings are equal if 80 bits of their hash are, two texts if their md5 is.
    """
    v, cover = difference_cover(length)
    depth = length - v + 1
    docs = id_and_text(docs, id_col, text_col)
    fp = F.unhex(F.md5("text"))
    prints = staged(
        docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), fp.alias("fp"), F.sha2("text", 256).alias("sha")), "prints"
    )
    copied = staged(prints.where(F.col("n_bytes") >= length).groupBy("fp").count().where("count > 1").select("fp"), "copied")

    # one row a text: those that may have copies meet, the others stay where they are
    long_ones = docs.where(F.octet_length("text") >= length).select(fp.alias("fp"), "text")
    copy = filled_bitmap(copied)
    texts = long_ones.where(~copy(F.col("fp"))).unionByName(
        long_ones.where(copy(F.col("fp"))).groupBy("fp").agg(F.first("text").alias("text")).sortWithinPartitions("fp")
    )
    total = prints.agg(F.sum("n_bytes")).first()[0] or 0

    def blocks(places: float) -> int:
        return max(LEAST_BLOCKS, int(places / BLOCK_NAMES))

    no_hint = texts.withColumn("hint", F.lit(None).cast("binary"))
    tied = staged(ties(no_hint, lambda n, _: sampled_places(n, depth, v, cover), depth, blocks(total * len(cover) / v)), "tied")

    # a suffix p has a sampled one at p + d; with d in [k * step, (k + 1) * step) it holds all of the string at p + d - k * step
    step = -(-v // SIDES)
    inner = length - step + 1

    def around(n: int, hint: bytes) -> np.ndarray:
        places = np.unique(np.frombuffer(hint, "<u4").astype(np.int64)[:, None] - step * np.arange(SIDES))
        return places[(places >= 0) & (places + inner <= n)]

    def suspects(n: int, hint: bytes) -> np.ndarray:
        steps = np.zeros(n + 1, dtype=np.int32)
        tied_at = np.frombuffer(hint, "<u4").astype(np.int64)
        np.add.at(steps, np.maximum(tied_at - step + 1, 0), 1)
        np.add.at(steps, tied_at + 1, -1)
        places = np.flatnonzero(np.cumsum(steps) > 0)
        return places[places + length <= n]

    def with_hints(of: DataFrame, hints: DataFrame, name: str) -> DataFrame:
        wanted = filled_bitmap(hints.select("fp"))
        return staged(of.where(wanted(F.col("fp"))).join(merged(hints).withColumnRenamed("places", "hint"), "fp").select("fp", "text", "hint"), name)

    def most(of: DataFrame, places_per_hint: int) -> float:
        return of.agg(F.sum(F.least(F.octet_length("text"), F.octet_length("hint") / 4 * places_per_hint))).first()[0] or 0

    near = with_hints(texts, tied, "near")
    close = staged(ties(near, around, inner, blocks(most(near, SIDES))), "close")
    at_hand = with_hints(near.select("fp", "text"), close, "suspects")
    repeated = staged(ties(at_hand, suspects, length, blocks(most(at_hand, step))), "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            spans, shas = [], []
            for text, places in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text, at = text.as_py(), np.unique(np.frombuffer(places.as_py(), "<u4").astype(np.int64))
                breaks = np.flatnonzero(np.diff(at) > length)
                runs = list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, -1]] + length).tolist(), strict=True))
                sha, kept_to = hashlib.sha256(), 0
                for start, end in [*runs, (len(text), len(text))]:
                    sha.update(text[kept_to:start])
                    kept_to = end
                spans.append([{"start": s, "end": e} for s, e in runs])
                shas.append(sha.hexdigest())
            yield {"fp": batch.column(0), "removed": spans, "kept": shas}

    # copied texts go whole, whatever else repeats them
    parts = arrow_map(
        at_hand.select("fp", "text").join(merged(repeated), "fp").join(copied, "fp", "left_anti").select("fp", "text", "places"),
        cut,
        "fp binary, removed array<struct<start: long, end: long>>, kept string",
    ).withColumn("whole", F.lit(False))
    nothing = hashlib.sha256().hexdigest()
    copies = copied.select("fp", F.expr("array(struct(0L as start, 0L as end))").alias("removed"), F.lit(nothing).alias("kept"), F.lit(True).alias("whole"))
    found = prints.join(parts.unionByName(copies), "fp", "left")
    removed = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(
        F.coalesce("removed", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))
    )
    return found.withColumn("removed", removed).select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        "removed",
    )

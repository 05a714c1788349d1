"""Near-duplicate groups: SuperMinHash, banding, exact verification, union-find.

Texts with equal shingle sets are one class and only a class's first document
takes part in the search. Candidates are classes that share a band of their
signatures. In each bucket one class is the centre. First each class is compared
with the best of its centres, on full sets, then with all centres that it is not
connected with yet; classes of a bucket that are not connected after that are
compared with each other. Pairs whose signatures are too far apart are left out. Within
what is already connected nothing is compared again, so a large group of near
copies costs as many comparisons as it has members.

Signatures of very small sets are not reliable, so these are linked without them:
sets are joined on what is left when the few elements go that a pair may differ in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map, id_and_text, staged
from perfmine.llm.components import components
from perfmine.llm.shingles import SLOTS, WordNumbers, fingerprint, in_portions, shingle_set, signatures, similar

PERCENT = 75
#: 32 bands of 4 slots: a pair of similarity 0.75 shares no band once in 190 000 times.
BAND_SLOTS = 4
#: A pair in which one set has no more shingles is linked by ``small_links``. The other
#: has a third more at most, and each lacks a quarter of its own at most in the other.
SMALL_SET = 9
LARGEST_PARTNER = SMALL_SET * 4 // 3
#: Share of equal slots below which two signatures are not compared on full sets.
#: For a pair of similarity 0.75 it lies five standard deviations below the mean.
LEAST_AGREEMENT = 0.55
#: Slots of the signatures that are made for classes left to compare, one bit each, and
#: the most bits that may differ: 256 do at similarity 0.75, 4.7 standard deviations less.
FINE_SLOTS, MOST_DIFFERENT = 2048, 327
BLOCK = 256
#: Bits of the bitmap of wanted ids: two megabytes.
FILTER_BITS = 1 << 24
_SLOT_BYTES = 2


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, signature, small) of every row.

    ``class`` is 128 bits of the shingle set, ``signature`` the low 16 bits of
    its slots; both are null for texts without words. ``small`` has the shingles
    themselves of a set of ``LARGEST_PARTNER`` or fewer.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers = WordNumbers()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for sets in in_portions(shingle_set(t.as_py(), numbers) for t in batch.column(1)):
                rows = (signatures(sets) & np.uint64(0xFFFF)).astype("<u2")
                yield {
                    "doc_id": ids[at : at + len(sets)],
                    "n_shingles": [len(s) for s in sets],
                    "class": [fingerprint(s) if len(s) else None for s in sets],
                    "signature": [r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)],
                    "small": [s.tobytes() if 0 < len(s) <= LARGEST_PARTNER else None for s in sets],
                }
                at += len(sets)

    return arrow_map(id_and_text(docs), work, "doc_id long, n_shingles long, class binary, signature binary, small binary")


def small_links(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever small sets of ``classes`` (id, small) are similar, and no others.

    With S what two sets share and x, y what each has besides, they are similar if
    100 |S| >= percent (|S| + x + y). Each set offers S for all x that leave a
    chance. Of those that offer the same S the one with the fewest elements besides
    is similar to each that is similar to any, so links to that one are enough.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, keys, shared, besides = [], [], [], []
            for doc, small in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(small.as_py(), dtype=np.uint64)
                for x in range(len(own)):
                    if 100 * (len(own) - x) < percent * len(own):
                        break
                    for left_out in combinations(range(len(own)), x):
                        ids.append(doc)
                        keys.append(fingerprint(np.delete(own, left_out)))
                        shared.append(len(own) - x)
                        besides.append(x)
            yield {"id": ids, "key": keys, "shared": shared, "besides": besides}

    offers = arrow_map(classes.where("small is not null").select("id", "small"), work, "id long, key binary, shared int, besides int")
    least = offers.groupBy("key").agg(F.min(F.struct("besides", "id")).alias("least"), F.count("*").alias("n")).where("n > 1")
    pairs = offers.join(least, "key").where(F.col("id") != F.col("least.id"))
    fits = 100 * F.col("shared") >= percent * (F.col("shared") + F.col("besides") + F.col("least.besides"))
    return pairs.where(fits).select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct()


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, id, centre, degree) of the buckets with two members or more.

    The centre is the member that shares the most bands with other classes: of a
    family of near copies the text they all derive from, which is closer to each
    copy than the copies are to each other. ``degree`` is the centre's number of
    shared bands.
    """
    width = _SLOT_BYTES * BAND_SLOTS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS // BAND_SLOTS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * width + 1, F.lit(width)))
    )
    rows = classes.select(F.posexplode(bands).alias("band", "bucket"), "id")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(rows.join(shared, "bucket"), "members")
    degrees = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = members.join(degrees, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("less"))).alias("top"))
    centres = ranked.select("bucket", (-F.col("top.less")).alias("centre"), F.col("top.degree").alias("degree"))
    return members.drop("n").join(centres, "bucket")


def maybe_among(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test of an id that is true for all of ``wanted`` (id), and for few others until the fixed bitmap fills up."""
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda id_: maybe(F.pmod(F.xxhash64(id_), F.lit(FILTER_BITS)))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` by id.

    A bitmap of fixed size tells most of the texts that nobody wants before the
    shuffle, so that only few of them travel. If it fills up, more travel.
    """
    some = docs.where(maybe_among(wanted)(F.col("doc_id")))
    return some.join(wanted, some["doc_id"] == wanted["id"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full shingle sets are similar.

    Each text is sent once per pair it is ``b`` of, and once per block of
    ``BLOCK`` pairs it is ``a`` of. A task holds the set of one ``a`` at a time.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = pairs.join(sizes, "a").select("a", "b", block.alias("block"))
    wanted = staged(
        dealt.select(F.col("b").alias("id"), "a", "block")
        .unionByName(dealt.select(F.col("a").alias("id"), "a", "block").distinct())
        .join(classes.select("id", "class"), "id"),
        "wanted",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers, group, centre = WordNumbers(), None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for own, block, member, kind, text in zip(*columns, batch.column(3), batch.column(4), strict=True):
                if (own, block) != group:
                    group, centre = (own, block), None
                if member == own and centre is not None:
                    continue
                shingles = shingle_set(text.as_py(), numbers)
                if fingerprint(shingles) != kind.as_py():
                    continue  # another text under the same id
                if member == own:
                    centre = shingles
                elif centre is not None and similar(centre, shingles, percent):
                    a.append(own)
                    b.append(member)
            yield {"a": a, "b": b}

    texts = texts_of(docs, wanted)
    # the centre comes first in its block
    ordered = (
        texts.select("a", "block", "id", "class", "text", (F.col("id") != F.col("a")).alias("later"))
        .repartition("a", "block")
        .sortWithinPartitions("a", "block", "later", "id")
        .drop("later")
    )
    return arrow_map(ordered, compare, "a long, b long")


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct ``pairs`` whose sizes and signatures allow the similarity."""
    of = classes.select("id", "n_shingles", "signature")
    left = of.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    right = of.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    joined = pairs.distinct().join(left, "a").join(right, "b")
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                s_a, s_b = (np.stack([np.frombuffer(x.as_py(), "<u2") for x in batch.column(i)]) for i in (2, 3))
                near = (s_a == s_b).mean(axis=1) >= LEAST_AGREEMENT
                yield {"a": batch.column(0).filter(pa.array(near)), "b": batch.column(1).filter(pa.array(near))}

    return arrow_map(joined.where(fits).select("a", "b", "s_a", "s_b"), close, "a long, b long")


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the component of ``id``, which is ``id`` itself where nothing is linked."""
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def fine_signatures(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, bits) of ``wanted`` (id, class): the lowest bit of ``FINE_SLOTS`` slots.

    Two sets of similarity s differ in a share of (1 - s) / 2 of these bits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers = WordNumbers()
        for batch in batches:
            ids, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for sets in in_portions((shingle_set(t.as_py(), numbers) for t in batch.column(2)), elements=40_000):
                rows = np.packbits((signatures(sets, FINE_SLOTS) & np.uint64(1)).astype(np.uint8), axis=1)
                fits = [fingerprint(s) == k for s, k in zip(sets, kinds[at : at + len(sets)], strict=True)]
                yield {
                    "id": [i for i, fit in zip(ids[at : at + len(sets)], fits, strict=True) if fit],
                    "bits": [r.tobytes() for r, fit in zip(rows, fits, strict=True) if fit],
                }
                at += len(sets)

    texts = texts_of(docs, wanted).select("id", "class", "text")
    return arrow_map(texts, work, "id long, bits binary").dropDuplicates(["id"])


def across(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share one of the buckets of ``members`` and may be similar.

    ``members`` is (bucket, band, id, component). A pair's fine signatures must
    be near enough; that is found out where the pair is, so other pairs are never
    written, and a pair is written in the first band that it shares only. The
    members of a bucket's largest component are only paired with those of others.
    Both sides are cut into blocks, and a pair of blocks is one group of at most
    ``2 * BLOCK`` rows on average, however large the bucket.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = (
        counts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
        .where("parts > 1")
        .select(
            "bucket",
            F.col("top.component").alias("most"),
            F.ceil(F.col("top.n") / BLOCK).cast("int").alias("most_blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("other_blocks"),
        )
    )
    rows = staged(members.join(mixed, "bucket"), "mixed")
    if rows.isEmpty():
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    wanted = staged(rows.select("id").distinct().join(classes.select("id", "class", "signature"), "id"), "wanted")
    fine = wanted.select("id", "signature").join(fine_signatures(wanted.select("id", "class"), docs), "id")

    in_most = F.col("component") == F.col("most")
    block = F.pmod(F.xxhash64("id"), F.when(in_most, F.col("most_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    # blocks of others are numbered from -1 down; a group is (x, y) with y an others' block and x a most's or an others' block from y on
    own = F.when(in_most, block).otherwise(-1 - block)
    others = F.transform(F.sequence(F.lit(1), F.col("other_blocks")), lambda i: -i)
    mosts = F.sequence(F.lit(0), F.col("most_blocks") - 1)
    groups = F.when(in_most, F.transform(others, lambda y: F.struct(F.col("block").alias("x"), y.alias("y")))).otherwise(
        F.array_union(
            F.transform(mosts, lambda x: F.struct(x.alias("x"), F.col("block").alias("y"))),
            F.transform(others, lambda o: F.struct(F.greatest(o, F.col("block")).alias("x"), F.least(o, F.col("block")).alias("y"))),
        )
    )
    dealt = (
        rows.withColumn("block", own)
        .select("bucket", "band", "id", "component", "block", F.explode(groups).alias("g"))
        .select("bucket", "band", "g.x", "g.y", "id", "component", "block")
        .join(fine, "id")
    )

    def pair(group: pa.Table) -> pa.Table:
        ids, parts, blocks = (group[c].to_numpy() for c in ("id", "component", "block"))
        bits, bands = (np.stack([np.frombuffer(x.as_py(), "<u8") for x in group[c]]) for c in ("bits", "signature"))
        x, y, band = (group[c][0].as_py() for c in ("x", "y", "band"))
        found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        right = np.flatnonzero(blocks == y)
        for i in np.flatnonzero(blocks == x):
            hit = right[(parts[right] != parts[i]) & ((ids[right] > ids[i]) | (x != y))]
            hit = hit[np.bitwise_count(bits[hit] ^ bits[i]).sum(axis=1) <= MOST_DIFFERENT]
            hit = hit[~(bands[hit, :band] == bands[i, :band]).any(axis=1)]
            found_a.append(np.minimum(ids[hit], ids[i]))
            found_b.append(np.maximum(ids[hit], ids[i]))
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(pair, "a long, b long")


def connected(docs: DataFrame, percent: int, owners: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component) of every row of ``docs``, in which an id has one text only.

    ``component`` is the id of some document of it, null for a row without an id.
    ``owners`` (doc_id, owner) lists documents that are connected with all others
    of their owner, whatever their texts.
    """
    sketches = staged(sketch(docs), "sketch")
    classes = staged(
        sketches.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("id"),
            F.min("n_shingles").alias("n_shingles"),
            F.min("signature").alias("signature"),
            F.min("small").alias("small"),
        ),
        "classes",
    )
    members = staged(buckets(classes), "buckets")
    of_class = classes.select("class", "id")

    links = staged(small_links(classes, percent), "small-links")
    if owners is not None:
        parts = staged(
            owners.join(sketches.select("doc_id", "class"), "doc_id")
            .join(of_class, "class", "left")
            .select("owner", F.coalesce("id", "doc_id").alias("id"))
            .distinct(),
            "parts",
        )
        firsts = parts.groupBy("owner").agg(F.min("id").alias("a"))
        links = links.unionByName(parts.join(firsts, "owner").where("a <> id").select("a", F.col("id").alias("b")))
    labels = None if links.isEmpty() else components(links)
    tested = None
    for step in range(3):
        now = labelled(members, labels)
        if step == 0:
            # one comparison a class, with the best of its centres
            best = members.groupBy("id").agg(F.max(F.struct("degree", (-F.col("centre")).alias("less"))).alias("top"))
            pairs = best.select((-F.col("top.less")).alias("a"), F.col("id").alias("b")).where("a <> b")
        elif step == 1:
            known = now.select(F.col("id").alias("centre"), F.col("component").alias("other")).distinct()
            pairs = now.join(known, "centre").where("component <> other").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        else:
            pairs = across(now.select("bucket", "band", "id", "component"), classes, docs)
        if step < 2:
            pairs = alike(pairs, classes)
        if tested is not None:
            again = (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high"))
            pairs = pairs.join(tested, again, "left_anti")
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            continue
        new = staged(verified(pairs, docs, classes, percent), "linked")
        done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        tested = done if tested is None else tested.unionByName(done)
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        labels = components(links)

    groups = labelled(of_class, labels).select("class", "component")
    found = sketches.drop("signature", "small").join(groups, "class", "left")
    if owners is not None and labels is not None:
        # a text without words is connected through its owner only
        blank = owners.join(labels, owners["doc_id"] == labels["id"]).select("doc_id", F.col("component").alias("through"))
        found = found.join(blank, "doc_id", "left").withColumn("component", F.coalesce("component", "through"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    sets of five-word shingles. ``component_id`` is the smallest id that can be
    reached, ``kept`` is true for the document that has it. Null, empty and blank
    texts are linked with nothing. A row without an id is linked with nothing,
    has no component and is kept. Rows that repeat an id are one document; if
    their texts differ, its links are those of all its texts, and all its rows
    have one component.

    Candidates come from signatures, links are confirmed on whole sets; no
    bucket, group or partner is capped. Pairs with a set of ``SMALL_SET`` shingles
    or fewer are found without signatures. Bands and bounds are made for a
    ``percent`` of 75 or more; less is refused. Two sets are equal if 128 bits of
    them are; a shingle is 64 bits.
    """
    if percent < PERCENT:
        raise ValueError(f"bands and bounds are made for {PERCENT} percent or more, not {percent}")
    docs = id_and_text(docs, id_col, text_col)
    text = F.xxhash64("text")
    several = staged(
        docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("doc_id"),
        "several",
    )
    if several.isEmpty():
        found = connected(docs, percent).withColumnRenamed("component", "component_id")
    else:
        # each text of such a document gets a number of its own
        marked = docs.join(several.withColumn("marked", F.lit(True)), "doc_id", "left")
        number = F.when(F.col("marked"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
        numbered = marked.select(number.alias("number"), "text", F.when(F.col("marked"), F.col("doc_id")).alias("owner"))
        owners = staged(numbered.where("owner is not null").select(F.col("number").alias("doc_id"), "owner").distinct(), "owners")
        parts = staged(
            connected(numbered.select(F.col("number").alias("doc_id"), "text"), percent, owners)
            .join(owners, "doc_id", "left")
            .select(F.coalesce("owner", "doc_id").alias("doc_id"), "n_shingles", "component"),
            "numbered",
        )
        least = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        found = parts.join(least, "component", "left")
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)

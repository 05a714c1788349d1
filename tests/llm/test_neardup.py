"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import DOCS, odd_rows
from pyspark.sql import functions as F

from perfmine.llm import neardup, queries
from perfmine.llm.components import components
from perfmine.llm.shingles import WordNumbers, shingle_set, signatures, similar


def shingles_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component, kept), by an index of all shingles and a search over links."""
    sets = [(i, shingles_of(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                index.setdefault(x, []).append(k)
    shared = {}
    for ks in index.values():
        for p in combinations(ks, 2):
            shared[p] = shared.get(p, 0) + 1
    for (p, q), n in shared.items():
        if 100 * n >= 75 * (len(sets[p][1]) + len(sets[q][1]) - n):
            a, b = sorted((root(sets[p][0]), root(sets[q][0])))
            parent[b] = a
    return sorted(((i, len(s), None, True) if i is None else (i, len(s), root(i), root(i) == i) for i, s in sets), key=repr)


def answers(df):
    return sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=repr)


def words(rnd, n, prefix=""):
    return [prefix + str(rnd.randrange(10**6)) for _ in range(n)]


def changed(rnd, text, n):
    text = list(text)
    for _ in range(n):
        text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
    return text


def test_families_chains_and_borders(spark):
    rnd = random.Random(5)
    texts = []
    for size in (3, 12, 40, 150):
        for _ in range(6):
            base = words(rnd, size)
            texts += [base, changed(rnd, base, 1), changed(rnd, base, max(1, size // 40)), changed(rnd, base, max(1, size // 20))]
    base = words(rnd, 120)
    for _ in range(25):  # a chain: each is near the one before, not near the first
        base = base[3:] + words(rnd, 3)
        texts.append(base)
    passage = words(rnd, 60)
    texts += [passage + words(rnd, 20 + k % 25) for k in range(40)]  # share much, mostly too little
    texts += [passage + words(rnd, 8) for _ in range(15)]
    rnd.shuffle(texts)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(texts)]
    rows += [(5000 + i, rows[i][1].upper().replace(" ", "  ")) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = answers(df)
    assert got == brute(rows)
    assert sum(not r[3] for r in got) > 60


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rnd = random.Random(6)
    passage = words(rnd, 40)
    rows = [(i, " ".join(passage + words(rnd, rnd.randrange(1, 20)))) for i in range(120)]
    assert answers(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_across_pairs_everything_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "MOST_DIFFERENT", neardup.FINE_SLOTS)
    rnd = random.Random(7)
    base = words(rnd, 60)
    texts = [(i, " ".join(changed(rnd, base, rnd.randrange(12)))) for i in range(70)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    classes = neardup.sketch(docs).withColumnRenamed("doc_id", "id")
    part = {i: rnd.choice([1, 1, 1, 2, 3]) for i, _ in texts}
    labels = spark.createDataFrame(list(part.items()), "id long, component long")
    members = neardup.buckets(classes).select("bucket", "band", "id")
    got = [tuple(r) for r in neardup.across(neardup.labelled(members, labels), classes, docs).collect()]
    together = {}
    for r in members.collect():
        together.setdefault(r.bucket, []).append(r.id)
    expected = {(a, b) for ids in together.values() for a, b in combinations(sorted(ids), 2) if part[a] != part[b]}
    assert len(expected) > 300
    assert len(got) == len(set(got)) and set(got) == expected


def test_fine_signatures_estimate_the_similarity(spark):
    rnd = random.Random(13)
    base = words(rnd, 200)
    texts = [(i, " ".join(changed(rnd, base, i % 9))) for i in range(45)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    fine = {r.id: np.frombuffer(r.bits, np.uint8) for r in neardup.fine_signatures(neardup.sketch(docs).select(F.col("doc_id").alias("id"), "class"), docs).collect()}
    for (a, s), (b, t) in combinations(texts, 2):
        one, two = shingles_of(s), shingles_of(t)
        expected = (1 - len(one & two) / len(one | two)) / 2
        assert abs(int(np.bitwise_count(fine[a] ^ fine[b]).sum()) / neardup.FINE_SLOTS - expected) < 0.045


def test_many_copies_and_near_copies(spark):
    rnd = random.Random(8)
    base = words(rnd, 100)
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join(changed(rnd, base, 2))) for i in range(150)]
    rows += [(3000 + i, " ".join(words(rnd, 30))) for i in range(50)]
    assert answers(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    got = answers(df.withColumns({c: F.lit("x") for c in ("id", "class", "bucket", "component", "signature", "kept", "a", "b")}))
    assert got == brute([(r[0], r[1]) for r in odd_rows()])


def test_one_id_with_two_texts(spark):
    rnd = random.Random(9)
    one, two = " ".join(words(rnd, 50)), " ".join(words(rnd, 50))
    rows = [(5, one), (5, two), (7, one), (8, two), (3, "alone"), (3, "alone")]
    assert answers(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeated_ids_carry_links_between_other_documents(spark):
    rnd = random.Random(21)
    a, b, c, d = (" ".join(words(rnd, 40)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (2, b), (9, c), (5, ""), (7, c), (7, d), (7, None), (3, d), (6, c), (6, d), (4, "other words")]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(got) == brute(rows)
    assert {r.component_id for r in neardup.near_duplicates(got).where("doc_id in (1, 2, 5)").collect()} == {1}


def test_small_sets_are_linked_without_signatures(spark, monkeypatch):
    rnd = random.Random(22)
    texts = []
    for n in (1, 4, 5, 6, 7, 8, 9, 11, 13, 16):
        for _ in range(12):
            base = words(rnd, n)
            texts += [base, [*base, "t"], ["h", *base], base[1:], [*base, "t", "u"], [*base[:-1], "v"], [*base, "w", "x", "y"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    # no bands at all: whatever is found comes from the sets themselves
    monkeypatch.setattr(neardup, "buckets", lambda classes: classes.limit(0).selectExpr("0L as bucket", "0 as band", "id", "id as centre", "1L as degree"))
    expected = brute(rows)
    small = {r[0] for r in expected if r[1] <= neardup.SMALL_SET}
    got = answers(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r for r in got if r[0] in small] == [r for r in expected if r[0] in small]
    assert sum(not r[3] for r in expected if r[0] in small) > 100


def test_lower_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=74)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "one text only")]])
def test_nothing_to_link(spark, rows):
    assert answers(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_query_equals_brute_force_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op3_minhash_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows)


def test_signatures_estimate_the_similarity():
    rnd, numbers = random.Random(10), WordNumbers()
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(60):
            n = 300
            both = int(n * 2 * share / (1 + share))
            common = words(rnd, both, "c")
            sets = [np.unique(np.fromiter((numbers[w.encode()] for w in common + words(rnd, n - both, side)), np.uint64)) for side in "ab"]
            a, b = signatures(sets)
            errors.append((a == b).mean() - len(np.intersect1d(*sets)) / len(np.union1d(*sets)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.1 * (share * (1 - share) / 128) ** 0.5


def test_signatures_do_not_depend_on_company():
    numbers, rnd = WordNumbers(), random.Random(11)
    sets = [shingle_set(" ".join(words(rnd, n)), numbers) for n in (1, 3, 5, 6, 40, 700, 0)]
    together = signatures(sets)
    for s, row in zip(sets, together):
        assert (signatures([s])[0] == row).all()
    assert (together[:-1] != 2**64 - 1).all() and (together[-1] == 2**64 - 1).all()


def test_similar_is_exact_at_the_border():
    at = lambda n, m, both: similar(np.arange(n, dtype=np.uint64), np.arange(n - both, n - both + m, dtype=np.uint64), 75)
    assert at(7, 7, 6) and not at(70, 71, 60) and at(4, 3, 3) and not at(5, 3, 3) and at(100, 75, 75) and not at(100, 74, 74)


def test_components(spark):
    rnd = random.Random(12)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1100)]
    edges += [(5000, 5000 + k) for k in range(300)] + [(3, None), (9999, 9999)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

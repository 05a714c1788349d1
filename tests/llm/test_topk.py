"""Top-k search against a plain nested loop."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from perfmine.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def clipped(score):
    """Scores beyond 64 bits stay at the end of the range."""
    return max(-(2**63), min(2**63 - 1, score))


def brute(rows, k=5, every=50, scale=256):
    seen = set()
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen.add((i, *(math.floor(scale * x) for x in v)))
    out = []
    for q in {r[0] for r in seen if r[0] % every == 0}:
        pairs = [(-clipped(sum(x * y for x, y in zip(a[1:], b[1:], strict=True))), b[0]) for a in seen if a[0] == q for b in seen if b[0] != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(pairs)[:k])]
    return sorted(out)


def answers(df, **kw):
    return sorted(tuple(r) for r in topk.top_k(df, **kw).collect())


def stored(spark, rows):
    """The rows as float32, as the operator sees them."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df, [tuple(r) for r in df.collect()]


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)], 0) for i in range(1500)]
    df, seen = stored(spark, rows)
    assert answers(df) == brute(seen)
    assert answers(df, k=2, query_every=7, scale=3) == brute(seen, k=2, every=7, scale=3)


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 64)
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(3)], 0) for i in range(600)]  # many ties and copies
    df, seen = stored(spark, rows)
    assert answers(df.repartition(5), query_every=10) == brute(seen, every=10)


def test_one_very_common_vector(spark):
    rows = [(i, [0.5, -0.25, 1.0], 0) for i in range(400)] + [(400 + i, [i / 100, 0.0, 0.0], 0) for i in range(200)]
    df, seen = stored(spark, rows)
    assert answers(df) == brute(seen)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0, -1.0], 0), (5, [1.0, -1.0], 0), (50, [0.1, 0.1], None), (-50, [-0.001, 0.0], None), (6, [2.0], 0)]
    df, seen = stored(spark, rows)
    padded = [(i, v + [0.0] if v and len(v) == 1 else v) for i, v, _ in seen]
    clash = df.withColumns({c: F.lit("x") for c in ("rank", "score", "query_id", "cell", "vector", "chunk")})
    assert answers(clash) == brute(padded)


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 1.0], 0), (0, [0.0, -1.0], 0), (7, [0.0, 1.0], 0), (7, [9.0, 0.0], 0), (7, [9.0, 0.0], 0), (3, [2.0, 2.0], 0), (50, [1.0, 0.5], 0)]
    rnd = random.Random(4)
    rows += [(rnd.randrange(40), [rnd.choice([-2.0, 0.5, 3.0]) for _ in range(2)], 0) for _ in range(200)]
    for order in (rows, rows[::-1]):
        df, seen = stored(spark, order)
        assert answers(df, query_every=10) == brute(seen, every=10)
        assert answers(df.where("vec_id in (0, 7)")) == brute([r for r in seen if r[0] in (0, 7)])


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(0, None, 0)]])
def test_no_queries(spark, rows):
    assert answers(spark.createDataFrame(rows, SCHEMA)) == []


def test_a_lone_query_and_empty_vectors(spark):
    assert answers(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)) == []
    assert answers(spark.createDataFrame([(0, [], 0), (1, [], 0)], SCHEMA)) == [(0, 1, 1, 0)]


def test_large_components(spark):
    df, seen = stored(spark, [(0, [1e9, 1.0], 0), (1, [1e7, 2.0], 0), (2, [-1e7, 0.5], 0), (3, [1e-3, 0.25], 0)])
    assert answers(df) == brute(seen)

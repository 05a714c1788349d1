"""Chunked scans against plain windows, and exact statistics, on skewed data."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from perfmine.functions import scan, stats


def skewed(spark, seed: int, n: int = 400):
    """One key holds most of the rows; positions have gaps."""
    rng = random.Random(seed)
    rows = []
    for pos in rng.sample(range(n * 5), n):
        key = 0 if rng.random() < 0.7 else rng.randrange(1, 6)
        rows.append((key, pos, rng.choice([None, 1, 2, 3]), rng.choice([None, None, None, rng.randrange(50)])))
    return spark.createDataFrame(rows, "key long, pos long, a long, b long")


@pytest.mark.parametrize("seed, chunk, exclusive", [(1, 7, False), (2, 50, False), (3, 13, True), (4, 10**6, False), (5, 10**6, True)])
def test_running_equals_plain_window(spark, rows, seed, chunk, exclusive):
    df = skewed(spark, seed)
    got = scan.running(
        df, ["key"], "pos", sums={"s": F.col("a")}, lasts={"l": F.col("b")}, mins={"m": F.col("b")}, chunk=chunk, exclusive=exclusive
    )
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = df.select(
        "*", F.coalesce(F.sum(F.coalesce("a", F.lit(0))).over(w), F.lit(0)).alias("s"), F.last("b", True).over(w).alias("l"), F.min("b").over(w).alias("m")
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("exclusive", [False, True])
def test_rows_far_apart_make_as_many_chunks_as_partitions(spark, rows, exclusive):
    """Positions a million apart: every chunk of fixed width holds one row."""
    df = skewed(spark, 9, 2000).withColumn("pos", F.col("pos") * 1_000_003 - 10**9)
    chunks = scan.row_chunks(df, ["key"], "pos", 6)
    per_key = chunks.groupBy("key").agg(F.countDistinct("_chunk").alias("n")).collect()
    assert max(r["n"] for r in per_key) in (5, 6) and len(per_key) == 6
    sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)
    exprs = dict(sums={"s": F.col("a")}, lasts={"l": F.col("b")}, mins={"m": F.col("b")}, exclusive=exclusive)
    got = scan.running(chunks, ["key"], "pos", **exprs)
    assert "_chunk" not in got.columns
    assert rows(got) == rows(scan.running(df, ["key"], "pos", chunk=10**12, **exprs))


@pytest.mark.parametrize("seed, chunk", [(6, 9), (7, 100), (8, 10**6)])
def test_anchor_is_last_value_minus_sum(spark, rows, seed, chunk):
    df = skewed(spark, seed)
    got = scan.running(df, ["key"], "pos", sums={"s": F.col("a")}, anchors={"base": (F.col("b"), "s")}, chunk=chunk)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("s", F.sum(F.coalesce("a", F.lit(0))).over(w))
    want = summed.withColumn("base", F.last(F.col("b") - F.col("s"), True).over(w))
    assert rows(got) == rows(want)


def exact_tail(wins: int, losses: int) -> float:
    n = wins + losses
    return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n


@pytest.mark.parametrize("wins, losses", [(0, 1), (1, 0), (4, 0), (19, 11), (11, 19), (30, 0), (15, 15), (1000, 950), (1500, 1600), (0, 40)])
def test_sign_tail(spark, wins, losses):
    df = spark.createDataFrame([(wins, losses)], "w long, l long")
    got = df.select(stats.sign_tail(F.col("w"), F.col("l"))).first()[0]
    assert got == pytest.approx(exact_tail(wins, losses), abs=1e-9)


def test_sign_tail_without_signs_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "w long, l long")
    assert df.select(stats.sign_tail(F.col("w"), F.col("l"))).first()[0] is None


def test_signs_leave_out_ties_and_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (float("nan"), 1.0), (1.0, float("nan")), (None, 1.0)], "o double, p double")
    o, p = F.col("o"), F.col("p")
    got = df.agg(
        stats.count_wins(o, p, 1.0), stats.count_losses(o, p, 1.0), stats.count_wins(p, o, 1.0), stats.count_losses(p, o, 1.0)
    ).first()
    assert tuple(got) == (1, 1, 1, 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_are_exact_under_skew(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "hot": np.concatenate([np.full(3000, 7.0), rng.normal(size=501)]),
        "one": np.array([3.5]),
        "even": rng.integers(0, 9, size=200).astype(float),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()}
    for name, vs in groups.items():
        want = np.quantile(vs, [0.25, 0.5, 0.75])
        assert [got[name][c] for c in ("q1", "median", "q3")] == pytest.approx(list(want))
        assert (got[name]["n"], got[name]["min"], got[name]["max"]) == (len(vs), vs.min(), vs.max())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert stats.exact_quantiles(df, ["g"], "v", {"median": 0.5}).count() == 0

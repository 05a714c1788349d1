"""The keyed store against a plain merge, and what it reads, writes and refuses."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine.session import scratch_path
from perfmine.sources.keyed import KeyedStore, LostRace, Version
from perfmine.streaming import jobs

SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("sha", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)
ROWS = "repo string, sha string, n bigint, names array<string>, seq bigint"


def make(spark, path, **options):
    return KeyedStore(spark, str(path), SCHEMA, ["repo", "sha"], **options)


def contents(df):
    return {(r["repo"], r["sha"]): (r["n"], r["names"]) for r in df.collect()}


def plain(batches):
    """Per key and column the value with the largest (order, batch) that is not null."""
    best = {}
    for at, batch in enumerate(batches):
        for repo, sha, n, names, seq in batch:
            if repo is None or sha is None or seq is None:
                continue
            row = best.setdefault((repo, sha), {})
            for name, value in (("n", n), ("names", names)):
                if value is not None and (name not in row or (seq, at) >= row[name][0]):
                    row[name] = ((seq, at), value)
    return {key: tuple(row.get(c, (None, None))[1] for c in ("n", "names")) for key, row in best.items()}


def test_merges_like_a_plain_upsert_at_every_compaction(spark, tmp_path):
    chance = random.Random(5)
    store = make(spark, tmp_path / "store", buckets=4)
    batches, wanted = [], [("r1", "c3"), ("r0", "c0"), ("zz", "zz")]
    for _ in range(7):
        seqs = chance.sample(range(1000), 12)
        batches.append([
            (chance.choice(["r0", "r1", None]), f"c{chance.randrange(4)}", chance.choice([None, seq]),
             chance.choice([None, [], [str(seq), None]]), chance.choice([seq, seq, seq, None]))
            for seq in seqs
        ])
        store.write(spark.createDataFrame(batches[-1], ROWS), "seq")
        store.compact(fanout=2)
        want = plain(batches)
        assert contents(store.read()) == want
        asked = spark.createDataFrame(wanted, "repo string, sha string")
        assert contents(store.lookup(asked)) == {k: v for k, v in want.items() if k in wanted}
    assert max(level for _, level in store.latest().parts) >= 2


def test_a_late_row_loses_and_an_equal_one_wins(spark, tmp_path):
    store = make(spark, tmp_path / "store")
    for row in (("r", "c", 5, None, 5), ("r", "c", 3, ["late"], 3), ("r", "d", 1, None, 7), ("r", "d", 2, None, 7)):
        store.write(spark.createDataFrame([row], ROWS), "seq")
    assert contents(store.read()) == {("r", "c"): (5, ["late"]), ("r", "d"): (2, None)}


def test_a_lost_race_shows_nothing(spark, tmp_path):
    store = make(spark, tmp_path / "store")
    row = spark.createDataFrame([("r", "c", 1, None, 1)], ROWS)
    base = store.latest()
    assert base == Version() and store.read().count() == 0
    store.write(row, "seq", base=base)
    with pytest.raises(LostRace):
        store.write(row.withColumn("n", F.lit(2)), "seq", base=base)
    # a writer that passed the check before the other one finished
    store._numbers = lambda: []
    with pytest.raises(LostRace):
        store._publish(Version(1, ((str(tmp_path / "store" / "data" / "x"), 0),)))
    assert contents(make(spark, tmp_path / "store").read()) == {("r", "c"): (1, None)}
    assert not [n for n in os.listdir(tmp_path / "store" / "versions") if n.startswith(".") and not n.endswith(".crc")]


def test_a_write_adds_its_own_rows_only_and_a_replay_none(spark, tmp_path):
    store = make(spark, tmp_path / "store")
    many = spark.range(5000).selectExpr("'r' repo", "cast(id as string) sha", "id n", "array('x') names", "id seq")
    first = store.write(many, "seq", "s", 0)
    second = store.write(many.limit(1).withColumn("extra", F.lit(1)), "seq", "s", 1)
    assert first.parts == second.parts[:1]
    assert spark.read.parquet(second.parts[1][0]).count() == 1
    assert store.write(many, "seq", "s", 1) == second
    assert store.write(many, "seq", "other", 1).number == second.number + 1


def test_lookup_reads_the_buckets_that_are_asked_for(spark, tmp_path):
    store = make(spark, tmp_path / "store", buckets=16)
    for part in range(2):
        store.write(spark.range(500).selectExpr("'r' repo", f"concat({part}, '-', id) sha", "id n", "array('x') names", "id seq"), "seq")
    store.compact(fanout=2)
    found = store.lookup(spark.createDataFrame([("r", "1-7")], "repo string, sha string"))
    assert contents(found) == {("r", "1-7"): (7, ["x"])}
    assert len([f for f in os.listdir(store.latest().parts[0][0]) if f.startswith("_bucket=")]) == 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_old_versions_and_their_folders_go(spark, tmp_path):
    store = make(spark, tmp_path / "store")
    for n in range(4):
        store.write(spark.createDataFrame([("r", f"c{n}", n, None, n)], ROWS), "seq")
    store.compact(fanout=4)
    store.expire(keep=1)
    folders = os.listdir(tmp_path / "store" / "data")
    assert [f for f in os.listdir(tmp_path / "store" / "versions") if not f.startswith(".")] == [f"{5:020d}.json"]
    assert [os.path.basename(store.latest().parts[0][0])] == folders
    assert len(contents(store.read())) == 4


def test_an_empty_write_and_a_key_without_values(spark, tmp_path):
    store = make(spark, tmp_path / "store")
    store.write(spark.createDataFrame([], ROWS), "seq")
    store.write(spark.createDataFrame([("r", "c", None, None, 1), (None, "c", 1, None, 1)], ROWS), "seq")
    assert contents(store.read()) == {("r", "c"): (None, None)}


def test_commits_come_once_over_batches_and_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    known = spark.createDataFrame([("a", "s1")], "repo string, after_commit string")
    rows = [[("a", "s1"), ("b", "s2"), ("a", "s2")], [("a", "s2"), ("a", "s3")], [("c", "s3"), ("c", "s4"), ("c", None)]]
    for batch in rows:
        spark.createDataFrame(batch, "repo string, sha string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("repo string, sha string").parquet(source)
        jobs.unseen_commits(stream, known, out, str(tmp_path / "progress")).awaitTermination()
    got = spark.read.schema("repo string, sha string, batch long").parquet(out).where("sha is not null")
    assert sorted(map(tuple, got.collect())) == [("a", "s2", 0), ("a", "s3", 1), ("c", "s4", 2)]


def test_a_replayed_batch_of_results_changes_nothing(spark, tmp_path):
    source, path = scratch_path(spark, "results"), str(tmp_path / "store")
    spark.createDataFrame([("r", "c", 9, 2)], "repo string, after_commit string, issue_number bigint, seq bigint").write.parquet(source)
    for progress in ("first", "lost"):
        stream = spark.readStream.schema("repo string, after_commit string, issue_number bigint, seq bigint").parquet(source)
        jobs.upsert_results(stream, path, str(tmp_path / progress)).awaitTermination()
    store = jobs.results_store(spark, path)
    assert store.latest().number == 1
    assert [tuple(r)[:3] for r in store.read().collect()] == [("r", "c", 9)]

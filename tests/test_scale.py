"""What keeps jobs on large tables within their limits: passes, tasks and rows, counted on small inputs."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine import schemas
from perfmine.functions import cells, scan
from perfmine.operators import changes
from perfmine.queries import streams
from perfmine.queries.registry import Inputs, all_queries
from perfmine.session import staged
from perfmine.sources import labels, lines

COVERAGE = "commit_id long, version string, test_path string, result string, file string, covered_lines string"
CHANGED = "commit_id long, version string, file string, line_no long"


def coverage_of(spark):
    """Tests of two files, with short, long, reversed and repeated ranges, and the lines that changed."""
    draw = random.Random(7)
    rows, brute = [], []
    changed = {(draw.choice("fg"), draw.choice([draw.randrange(200), draw.randrange(5000)])) for _ in range(120)}
    for i in range(60):
        file, parts = draw.choice("fgh"), []
        for _ in range(draw.randrange(1, 5)):
            low = draw.choice([draw.randrange(130), draw.randrange(4000)])
            high = low + draw.choice([-3, 0, 1, 5, 62, 63, 64, 65, 700])
            parts.append(f" {low} - {high}" if high != low else str(low))
            brute += [(1, f"T{i}", file, n) for f, n in changed if f == file and low <= n <= high]
        rows.append((1, "patched", f"T{i}", "PASSED", file, ",".join([*parts, " "])))
    return spark.createDataFrame(rows, COVERAGE), spark.createDataFrame([(1, "patched", f, n) for f, n in changed], CHANGED), brute


def test_lines_in_cells_are_those_of_the_ranges(spark):
    coverage, changed, brute = coverage_of(spark)
    got = changes.changed_and_covered(changed, coverage)
    assert got.columns == ["commit_id", "version", "file", "test_path", "result", "line_no"]
    assert sorted((r.commit_id, r.test_path, r.file, r.line_no) for r in got.collect()) == sorted(brute)
    tests = {(r.commit_id, r.test_path) for r in changes.covering_tests(changed, coverage).collect()}
    assert tests == {b[:2] for b in brute}


def test_changed_lines_of_a_file_meet_a_range_as_few_rows(spark):
    changed = spark.range(640).selectExpr("1L as commit_id", "'patched' as version", "'f' as file", "id as line_no")
    coverage = spark.createDataFrame([(1, "patched", "T", "PASSED", "f", "0-63,100-101,0-639")], COVERAGE)
    assert changes._changed_ranges(changed, coverage).count() == 1 + 1 + 10
    assert changes.changed_and_covered(changed, coverage).count() == 64 + 2 + 640


def test_changed_lines_are_worked_out_once(spark, tmp_path):
    coverage, changed, brute = coverage_of(spark)
    changed.write.parquet(f"{tmp_path}/changed")
    tests = changes.covering_tests(spark.read.parquet(f"{tmp_path}/changed"), coverage)
    assert not any(str(tmp_path) in f for f in tests.inputFiles())
    assert {(r.commit_id, r.test_path) for r in tests.collect()} == {b[:2] for b in brute}


def test_bounds_of_row_chunks_are_looked_for_in_a_table(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).selectExpr("id % 3 as k", "id as seq").mapInArrow(count, "k long, seq long")
    assert scan.cut(rows, ["k"], "seq", None).count() == 1000
    assert seen.value == 1000


def test_lines_of_a_cache_are_read_as_by_the_json_source(spark, tmp_path):
    both = '{"commit_year_by_repo_sha": {%s}, "repo_stars": {%s}}'
    texts = [both % p for p in (
        ('"a/b@1":2014', '"a/b":7'), ('"x":1,"x":null', '"r":1, "q": 2'), ("", ""), ('"q\\"uo":3', '"\\u0041":4'), ('"big":99999999999', '"big":5'),
        ('"d":1.5', '"d":2'), ('"s":"2014"', '"s":5'), ('"z":007', '"z":1'), ('"b{r},":1', '"c:o":1'), ('"é":-1', '"":0'), ('"o":{"x":1}', '"o":9'),
        (",".join(f'"k{i}":{i}' for i in range(3000)), '"long":1'),
    )]
    texts += [f"[{texts[0]},{texts[1]}]", texts[0] + " tail", " " + texts[0], '{"repo_stars":{"only":3}}', "", "null", "[]", "broken {", '{"a":1}']
    (tmp_path / "cache").write_text("\n".join(texts), encoding="utf-8")
    source = spark.read.schema(schemas.YEAR_STAR_CACHE).json(f"{tmp_path}/cache")
    got = labels.read_year_star_cache(spark, f"{tmp_path}/cache", multi_line=False)
    for table, field in zip(got, schemas.YEAR_STAR_CACHE.names, strict=True):
        expected = source.select(F.explode(field)).collect()
        assert sorted(map(tuple, table.collect()), key=repr) == sorted(map(tuple, expected), key=repr)
        assert "Scan json" not in table._jdf.queryExecution().executedPlan().toString()


def test_the_path_of_a_log_is_taken_apart_once_per_block(spark, tmp_path):
    for name in ("c1/original_repo_mvnw_1.log", "c1/other.log"):
        os.makedirs(tmp_path / "c1", exist_ok=True)
        (tmp_path / name).write_text("first\nsecond\n")
    got = lines.read_log_set(spark, str(tmp_path / "c1"), F.regexp_extract("file", r"/(c\d)/", 1))
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("c1", "original", 1, 1, "first"), ("c1", "original", 1, 2, "second")]


def test_a_staged_table_is_not_written_again(spark):
    table = staged(spark.range(3).withColumn("_staged", F.lit(1)), "numbers")
    assert staged(table, "numbers") is table
    assert staged(table.where("id > 1"), "numbers").collect() == table.where("id > 1").collect()


@pytest.mark.parametrize("batches", [1, 3])
def test_a_batch_of_a_stream_is_many_files(spark, tmp_path, batches):
    seen = []
    stream = streams.stream_of(Inputs(spark, ""), spark.range(1000), f"many-{batches}", batches)
    query = stream.writeStream.foreachBatch(lambda df, i: seen.append((len(df.inputFiles()), df.count())))
    query.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == batches and sum(n for _, n in seen) == 1000
    assert max(n for _, n in seen) < 2 * 1000 / batches


def test_cells_of_one_row_group_are_decoded_by_many_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        decoded = all_queries()["src_02_tolerant_cells"](spark, str(tmp_path))
        assert decoded.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert decoded.count() == 4000


def test_a_cell_without_outer_quotes_has_one_form(spark):
    texts = ["not json", '["a"]', "['a', None]", '"[""a""]"', "\t'[\"a\"]'", '{"k": 1}', '"\\"[1]\\""', "", None, '""', "'x", '["a"] junk', "null", "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    kind = T.ArrayType(T.StringType())
    got = [r[0] for r in df.orderBy("i").select(cells.decode_cell(F.col("t"), kind)).collect()]
    assert got == [None, ["a"], ["a", None], ["a"], ["a"], None, ["1"], None, None, None, None, None, None, None]
    plan = df.select(cells.decode_cell(F.col("t"), kind, False))._jdf.queryExecution().analyzed().toString()
    assert "array_distinct" in plan

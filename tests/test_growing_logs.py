"""Numbering of logs that grow, in batches of a stream."""

from __future__ import annotations

import os

import pytest

from perfmine.sources import lines
from perfmine.streaming import jobs


def put(folder, log, part, content, mode="w"):
    os.makedirs(f"{folder}/log={log}", exist_ok=True)
    with open(f"{folder}/log={log}/part-{part}.txt", mode, encoding="utf-8") as out:
        out.write("".join(f"{line}\n" for line in content))


@pytest.fixture
def number(spark, tmp_path):
    """Run the stream over what is there; rows and the batches written so far."""

    def run(stream="lines"):
        source = lines.text_rows(spark.readStream.text(f"{tmp_path}/logs/log=*"), lines.folder_of())
        jobs.number_lines(source, f"{tmp_path}/out", f"{tmp_path}/progress-{stream}", stream=stream).awaitTermination()
        return sorted(tuple(r) for r in jobs.numbered_lines(spark, f"{tmp_path}/out").collect())

    return run


def as_one_read(spark, tmp_path):
    return sorted(tuple(r) for r in lines.read_lines(spark, f"{tmp_path}/logs/log=*", lines.folder_of()).select("log", "line_no", "line").collect())


def test_batches_number_as_one_read(spark, tmp_path, number):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    logs = f"{tmp_path}/logs"
    try:
        spark.conf.set(keys[0], 64)  # several blocks a file
        spark.conf.set(keys[1], 0)
        put(logs, "a", 0, [f"a{i}" + "x" * (i % 30) for i in range(60)])
        put(logs, "b", 2, ["b0", "", "b0"])
        first = number()
        put(logs, "a", 9, ["late", "late"])
        put(logs, "a", 10, [f"end{i}" for i in range(20)])
        put(logs, "c", 0, ["c"])
        second = number()
        put(logs, "d", 0, [])
        third = number()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(first) == 63 and set(first) < set(second)
    assert second == third == as_one_read(spark, tmp_path)
    assert [n for log, n, _ in second if log == "a"] == list(range(1, 83))


def test_replayed_and_appended_files(spark, tmp_path, number):
    logs = f"{tmp_path}/logs"
    put(logs, "a", 0, ["one", "two"])
    put(logs, "a", 1, ["three"])
    before = number()
    # a new progress delivers every file again
    assert number("again") == before == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three")]
    put(logs, "a", 1, ["four", "five"], "a")
    put(logs, "a", 2, ["six"])
    got = number("third")
    assert [(n, text) for _, n, text in got] == list(enumerate(["one", "two", "three", "four", "five", "six"], 1))
    assert got == as_one_read(spark, tmp_path)


def test_lines_before_numbered_ones_are_an_error(spark, tmp_path, number):
    logs = f"{tmp_path}/logs"
    put(logs, "a", 5, ["x"])
    before = number()
    put(logs, "a", 4, ["y"])
    with pytest.raises(Exception, match="before a file that is numbered"):
        number()
    assert sorted(tuple(r) for r in jobs.numbered_lines(spark, f"{tmp_path}/out").collect()) == before

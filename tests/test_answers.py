"""The way of an answer: files of the adapter, questions without one, the cache, the next run."""

from __future__ import annotations

import hashlib
import json

from perfmine.plans import mining as plan
from perfmine.sources import answers


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def answer(text):
    return {"samples": [{"content": text}, {"content": "second"}]}


ASKED = [(md5(f"q{i}"), i) for i in range(40)]
FRESH = "prompt_hash string, seq bigint, response struct<samples: array<struct<content: string>>>"


def verdicts(df):
    return {r["number"]: r["confirmed"] for r in df.collect()}


def test_files_then_pending_then_nothing_to_ask(spark, tmp_path):
    files, cache = tmp_path / "files", str(tmp_path / "cache")
    files.mkdir()
    for key, i in ASKED[:10]:
        for version in range(2):
            body = {"prompt": {"messages": [], "temp": 0.0, "sample_size": 2, "model": "m"},
                    "response": answer(("Yes" if i % 2 else "no") if version == 0 else "later"), "invocation_time": 1.5}
            (files / f"{key}-{version}.json").write_text(json.dumps(body, indent=1))
    asked = spark.createDataFrame(ASKED, "prompt_hash string, number int")
    known, pending = plan.judged(asked, cache)
    assert set(verdicts(known).values()) == {None} and pending.count() == 40

    answers.append_entries(answers.read_answer_files(spark, str(files)), cache)
    known, pending = plan.judged(asked, cache)
    assert verdicts(known) == {i: (bool(i % 2) if i < 10 else None) for _, i in ASKED}
    assert sorted(r["number"] for r in pending.collect()) == list(range(10, 40))

    said = [(r["prompt_hash"], r["number"], answer(" YES, it does")) for r in pending.collect()]
    answers.record_answers(spark.createDataFrame(said, FRESH), cache)
    known, pending = plan.judged(asked, cache)
    assert pending.count() == 0
    assert verdicts(known) == {i: i >= 10 or bool(i % 2) for _, i in ASKED}


def test_a_repeated_answer_is_stored_once(spark, tmp_path):
    cache, key = str(tmp_path / "cache"), md5("q")
    rows = spark.createDataFrame([(key, 2, answer("no")), (key, 1, answer("yes")), (None, 3, answer("x"))], FRESH)
    for _ in range(2):
        answers.record_answers(rows, cache)
    got = answers.stored_answers(cache, rows).collect()
    assert [(r["prompt_hash"], r["version"], r["response"]["samples"][0]["content"]) for r in got] == [(key, 0, "yes")]
    assert answers.stored_answers(cache, rows.where("false")).count() == 0


def test_only_folders_of_asked_hashes_are_read(spark, tmp_path):
    cache = str(tmp_path / "cache")
    answers.record_answers(spark.createDataFrame([(k, i, answer("yes")) for k, i in ASKED], FRESH), cache)
    found = answers.stored_answers(cache, spark.createDataFrame(ASKED[:1], "prompt_hash string, number int"))
    assert [r["prompt_hash"] for r in found.collect()] == [ASKED[0][0]]
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert f"= {ASKED[0][0][:2]}" in filters


def test_prefixes_that_look_like_numbers_stay_text(spark, tmp_path):
    cache = str(tmp_path / "cache")
    keys = ["00" + "a" * 30, "01" + "b" * 30, "1e" + "c" * 30]
    rows = spark.createDataFrame([(k, i, answer("yes")) for i, k in enumerate(keys)], FRESH)
    answers.record_answers(rows, cache)
    assert sorted(r["prompt_hash"] for r in answers.stored_answers(cache, rows).collect()) == keys

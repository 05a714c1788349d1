"""Readers and writers on files of the formats they are for."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from perfmine import schemas
from perfmine.operators import changes, dataset as ops
from perfmine.sources import answers, coverage, dataset, labels, lines, results, store


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return path


@pytest.mark.parametrize("block", [64, 10**6])
def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path, block):
    logs = {"a": [f"a{i} " + "x" * (i % 40) for i in range(300)], "b": [f"b{i}" for i in range(7)], "c": ["", "z"]}
    for name, content in logs.items():
        put(tmp_path, f"{name}.log", "\n".join(content) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], block)
        spark.conf.set(keys[1], 0)
        got = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_log = {}
    for r in got:
        by_log.setdefault(os.path.basename(r["log"])[0], []).append((r["line_no"], r["line"]))
    assert {k: sorted(v) for k, v in by_log.items()} == {k: list(enumerate(v, 1)) for k, v in logs.items()}


def test_log_sets_of_both_names(spark, tmp_path):
    for name in ("c1/logs/original_repo_mvnw_1.log", "c1/logs/patched_repo_mvnw_12.log", "c2/mvnw_0_original.log", "c2/mvnw_3_new_patched.log", "c2/other.log"):
        put(tmp_path, name, f"{name}\nsecond\n")
    got = lines.read_log_set(spark, str(tmp_path / "*") + "/", F.regexp_extract("file", r"/(c\d)/", 1))
    deep = lines.read_log_set(spark, str(tmp_path / "c1" / "logs"), F.regexp_extract("file", r"/(c\d)/", 1))
    rows = sorted(tuple(r)[:4] for r in got.unionByName(deep).distinct().collect())
    keys = [("c1", "original", 1), ("c1", "patched", 12), ("c2", "original", 1), ("c2", "patched", 4)]
    assert rows == [(*k, n) for k in keys for n in (1, 2)]


def test_lines_are_not_shuffled(spark, tmp_path):
    put(tmp_path, "log=1/part-0.txt", "first\nsecond\n")
    got = lines.read_lines(spark, str(tmp_path), log=lines.folder_of())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_part_files_follow_their_number(spark, tmp_path):
    put(tmp_path, "log=1/part-99999-x.txt", "first\n")
    put(tmp_path, "log=1/part-100000-x.txt", "second\n")
    got = lines.read_lines(spark, str(tmp_path), log=lines.folder_of()).collect()
    assert {(r["log"], r["line_no"], r["line"]) for r in got} == {("1", 1, "first"), ("1", 2, "second")}


def test_dataset_csv(spark, tmp_path):
    header = ",".join(f.name for f in schemas.DATASET)
    body = (
        'o/r,abc,12.0,docker_image_built,0.5,x,"{""patched_outperforms_original"": [""T""]}",,7,True,"[""m1"", ""m2""]","[\'a\', \'b\']"\n'
        'o/r,"d\ne",,,,,,,,,,not a list\n'
    )
    path = put(tmp_path, "dataset.csv", header + "\n" + body)
    first, second = sorted(dataset.read_dataset_csv(spark, path).collect(), key=lambda r: r["after_commit"])
    assert first["issue_number"] == 12 and first["pr_number"] == 7 and first["exec_time_improvement"] == 0.5 and first["p_value"] is None
    assert first["test_class_improvements"] == {"patched_outperforms_original": ["T"]}
    assert first["modified_modules"] == ["m1", "m2"] and first["changed_files"] == ["a", "b"]
    assert second["after_commit"] == "d\ne" and second["changed_files"] is None and second["issue_number"] is None


def test_columns_of_a_dataset_go_by_name(spark, tmp_path):
    names = [f.name for f in schemas.DATASET]
    row = {"repo": "o/r", "after_commit": "s", "pr_number": "7"}
    mixed = [*names[::-1], "further"]
    path = put(tmp_path, "mixed.csv", ",".join(mixed) + "\n" + ",".join(row.get(n, "") for n in mixed) + "\n")
    got = dataset.read_dataset_csv(spark, path).first()
    assert (got["repo"], got["after_commit"], got["pr_number"]) == ("o/r", "s", 7)
    path = put(tmp_path, "short.csv", ",".join(names[1:]) + "\n")
    with pytest.raises(ValueError, match=names[0]):
        dataset.read_dataset_csv(spark, path)


def test_a_lost_swap_raises(spark, tmp_path):
    path = str(tmp_path / "store")
    row = ("r", "a", 1, None, 0.25, None, {"k": ["x"]}, None, None, "yes", ["m"], [])
    rows = spark.createDataFrame([row], schemas.DATASET)
    first = dataset.save_dataset(rows, path, None)
    second = dataset.save_dataset(rows, path, store.current(spark, path))
    assert store.current(spark, path).endswith(second.rsplit("/", 1)[-1])
    for stale in (first, None):
        with pytest.raises(RuntimeError, match="another writer"):
            dataset.save_dataset(rows, path, stale)
    assert store.current(spark, path).endswith(second.rsplit("/", 1)[-1])


def test_store_moves_its_pointer(spark, tmp_path):
    path = str(tmp_path / "store")
    assert dataset.load_dataset(spark, path).count() == 0
    row = ("r", "a", 1, None, 0.25, None, {"k": ["x"]}, None, None, "yes", ["m"], [])
    dataset.save_dataset(spark.createDataFrame([row], schemas.DATASET), path)
    first = store.current(spark, path)
    update = spark.createDataFrame([("r", "a", None, "done") + (None,) * 8, ("r", "b") + (None,) * 10], schemas.DATASET)
    dataset.save_dataset(ops.upsert(dataset.load_dataset(spark, path), update), path)
    assert store.current(spark, path) != first and os.path.isdir(first)
    got = {tuple(r) for r in dataset.load_dataset(spark, path).select("after_commit", "issue_number", "exec_status", "changed_files").collect() for r in [(r[0], r[1], r[2], str(r[3]))]}
    assert got == {("a", 1, "done", "[]"), ("b", None, None, "None")}


def test_label_files(spark, tmp_path, rows):
    legend = put(tmp_path, "j1.csv", 'issue,ground-truth_patch,generated_patch,judgment,extra info,Exact Match,9\ni1,g,p,Off,"a, b",x,4\n,,,,,y,1\n')
    plain = put(tmp_path, "j2.csv", "issue,ground-truth_patch,generated_patch,judgment,extra info\ni1,g,N/A,N/A,\n")
    assert rows(labels.read_patch_judgements(spark, legend)) == [("i1", "g", "p", "Off", "a, b")]
    assert rows(labels.read_patch_judgements(spark, plain)) == [("i1", "g", "N/A", "N/A", None)]
    accuracy = put(tmp_path, "a.csv", "commit_url,d,e,interesting\nu,FALSE,No,\nv,TRUE,Yes,x\n")
    assert rows(labels.read_accuracy_sample(spark, accuracy), "commit_url", "is_detected", "is_confirmed") == [("u", False, False), ("v", True, True)]
    precision = put(tmp_path, "p.csv", "issue_link,ground_truth_patch,is_exec_improvement,x\ni,g,Yes,**\n")
    assert rows(labels.read_precision_sample(spark, precision)) == [("i", "g", "Yes", "**")]
    flags = put(tmp_path, "f.txt", "# query x/y True\n\na/b True\nc/d False\n\n\na/b True\n\nchecked=True with it\nhttps://h/o/r/commit/1 fail\n")
    assert rows(labels.read_flags(spark, flags)) == [("a/b", True), ("c/d", False)]
    codes = put(tmp_path, "c.txt", "https://h/o/r/commit/1\nhttps://h/o/r/commit/2,pr")
    assert rows(labels.read_commit_codes(spark, codes)) == [("https://h/o/r/commit/1", None), ("https://h/o/r/commit/2", "pr")]


def test_lists_caches_and_build_files(spark, tmp_path, rows):
    put(tmp_path / "t", "o__r_1234567/improvement_tests.txt", "p.A\np.B")
    put(tmp_path / "t", "k-k-1234567_bak/improvement_tests.txt", "p.C\n\n")
    got = labels.read_test_lists(spark, str(tmp_path / "t" / "*" / "improvement_tests.txt"))
    assert rows(got) == [("k-k-1234567_bak", "p.C"), ("o__r_1234567", "p.A"), ("o__r_1234567", "p.B")]
    cache = put(tmp_path, "cache.json", json.dumps({"commit_year_by_repo_sha": {"o/r@1": 2020}, "repo_stars": {"o/r": 5}}, indent=2))
    years, stars = labels.read_year_star_cache(spark, cache)
    assert rows(years) == [("o/r@1", 2020)] and rows(stars) == [("o/r", 5)]
    put(tmp_path / "repos", "7/pom.xml", "<project>\n</project>")
    put(tmp_path / "repos", "8/pom.xml", "x")
    got = labels.read_build_files(spark, str(tmp_path / "repos"), ["pom.xml"])
    assert rows(got) == [("7", "pom.xml", "<project>\n</project>"), ("8", "pom.xml", "x")]


def test_answer_files(spark, tmp_path, rows):
    digest = "0" * 31 + "a"
    for version, text in ((1, "later"), (0, "Yes")):
        answer = {
            "prompt": {"messages": [{"role": "user", "content": "q"}], "temp": 0, "sample_size": 1, "model": "m"},
            "response": {"samples": [{"content": text}, {"content": "second"}]}, "invocation_time": 1.5,
        }
        put(tmp_path, f"{digest}-{version}.json", json.dumps(answer))
    put(tmp_path, "notes.json", "{}")
    assert rows(answers.first_answers(answers.read_answer_files(spark, str(tmp_path)))) == [(digest, "Yes")]


def test_coverage_report_files(spark, tmp_path, rows):
    report = {"tests": [
        {"uniformPath": "p/T/m", "result": "passed", "duration": 1.5, "paths": [
            {"path": "p", "files": [{"fileName": "A.java", "coveredLines": "1-3"}, {"fileName": "B.java", "coveredLines": ""}]},
            {"path": "", "files": [{"fileName": "C.java", "coveredLines": "9"}]}]},
        {"uniformPath": "p/T/n", "result": "FAILED", "duration": 0.5, "paths": []}]}
    put(tmp_path, "original__core.json", json.dumps(report, indent=1))
    read = coverage.read_report_files(spark, str(tmp_path), r"/([a-z]+)__([a-z]+)\.json$")
    got = changes.coverage_rows(read, keys=("version", "module"))
    assert rows(got, "test_path", "result", "file", "covered_lines") == sorted([
        ("core/src/test/java/p/T/m", "PASSED", "core/src/main/java/p/A.java", "1-3"),
        ("core/src/test/java/p/T/m", "PASSED", None, None),
        ("core/src/test/java/p/T/m", "PASSED", "core/src/main/java/C.java", "9"),
        ("core/src/test/java/p/T/n", "FAILED", None, None)], key=repr)


def test_found_commit_csv(spark, tmp_path, rows):
    found = [("o", "r", "1", "u", ""), ("o", "r", "1", "u", ""), ("o", "r", "2", "v", 'say "x", y')]
    df = spark.createDataFrame(found, "owner string, repo string, commit_hash string, url string, message string")
    path = str(tmp_path / "found")
    results.write_found_commits(df, path)
    assert rows(results.read_found_commits(spark, path)) == sorted(set(found), key=repr)

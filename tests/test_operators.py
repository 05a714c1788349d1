"""Operators on small fixtures, against brute force where they are involved."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perfmine.functions import scan
from perfmine.operators import applog, buildconf, changes, dataset, evaluation, measurement, mining, reports, tasks
from perfmine.plans import measurement as measured


# --- running text of found commits -------------------------------------------------


INFO, LINK = "12:00:00,1 root INFO ", "Found performance commit: https://github.com/o/r/commit/"

LOGS = [
    # an INFO line, a continuation with a tab, two links: the second shows what the first has left over
    ([INFO + "Commit - fast, yes", "\tand - small ", LINK + "1", LINK + "2"], [(2, "fast  yes and - small"), (3, "small")]),
    # no separator: everything is cut off, and what follows starts anew
    ([INFO + "x", LINK + "1", "a - b", "c", LINK + "2"], [(1, ""), (4, "b c")]),
    # a new INFO line drops the text before it; a separator can arise at a join
    ([INFO + "old - text", INFO + "new -", "line", LINK + "1"], [(3, "line")]),
    # nothing but plain lines before the first link
    (["a", "- b", LINK + "1"], [(2, "b")]),
    ([LINK + "1"], [(0, "")]),
]


def random_log(rng, n):
    """(kind, payload) of each line."""
    pieces = ["a - b", "x -", "- ", "--", "-,y", "c, d", "", "-", " -- -", "plain", "\tq - r - s, t"]
    starts = ["Commit - fast, yes", "x", "a - b - c -", "z,-, w"]
    kinds = rng.choices(["info", "link", "plain"], [6, 24, 70], k=n)
    return [(k, {"info": rng.choice(starts), "link": f"{rng.randrange(99):07x}", "plain": rng.choice(pieces)}[k]) for k in kinds]


def as_lines(log):
    return [{"info": INFO, "link": LINK, "plain": ""}[kind] + payload for kind, payload in log]


def found(spark, logs):
    rows = [(f, n, line) for f, lines in logs.items() for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file_no long, line_no long, line string")
    return {(r["file_no"], r["line_no"]): r["message"] for r in applog.found_commits(df).collect()}


def test_found_commits_of_known_logs(spark):
    got = found(spark, {f: lines for f, (lines, _) in enumerate(LOGS)})
    assert got == {(f, n): message for f, (_, messages) in enumerate(LOGS) for n, message in messages}


@pytest.mark.parametrize("seed, chunk, span", [(1, 5, 4), (2, 17, 3), (3, 10**6, 1024), (4, 3, 2)])
def test_each_found_commit_follows_from_the_one_before(spark, monkeypatch, seed, chunk, span):
    """A link shows what follows the first separator of the text it took over and the lines since."""
    monkeypatch.setattr(scan.running, "__defaults__", tuple(chunk if d == scan.CHUNK else d for d in scan.running.__defaults__))
    monkeypatch.setattr(applog, "_SPAN", span)
    rng = random.Random(seed)
    logs = {f: random_log(rng, n) for f, n in ((0, 250), (1, 40), (2, 3))}
    got = found(spark, {f: as_lines(log) for f, log in logs.items()})
    links = {(f, n) for f, log in logs.items() for n, (kind, _) in enumerate(log) if kind == "link"}
    assert set(got) == links
    for f, n in links:
        log = logs[f]
        start = max((k for k in range(n) if log[k][0] != "plain"), default=-1)
        taken = "" if start < 0 else log[start][1] if log[start][0] == "info" else got[f, start]
        text = " ".join([taken, *(payload.strip() for _, payload in log[start + 1 : n])]).replace(",", " ")
        assert got[f, n] == text.partition("- ")[2]


# --- verdicts, forks, judged patches, versions --------------------------------------------


def test_a_verdict_belongs_to_one_commit_and_issue(spark, rows):
    commits = spark.createDataFrame([("o/r", "c1", "fixes #1"), ("o/r", "c2", "closes #1 too")], "repo string, sha string, message string")
    issues = spark.createDataFrame([("o/r", 1, "slow", None, False)], "repo string, number long, title string, body string, is_pull_request boolean")
    asked = mining.prompts(mining.message_refs(commits), commits, issues)
    verdicts = asked.where("sha = 'c1'").select("prompt_hash", F.lit(" Yes.").alias("response"))
    assert rows(mining.with_verdicts(asked, verdicts), "sha", "confirmed") == [("c1", True), ("c2", None)]
    assert rows(mining.confirmed_refs(asked, verdicts), "sha") == [("c1",)]
    assert rows(mining.to_judge(asked, verdicts), "sha") == [("c2",)]


def test_a_fork_does_not_repeat_a_commit(spark, rows):
    commits = spark.createDataFrame([("b/x", "s1"), ("a/fork", "s1"), ("b/x", "s2"), ("c/y", "s3"), ("b/x", "s3")], "repo string, sha string")
    known = spark.createDataFrame([("b/x", "s2"), ("b/x", "s3")], "repo string, after_commit string")
    assert rows(mining.unseen(commits, known)) == [("a/fork", "s1"), ("c/y", "s3")]


def test_judged_patches_match_in_their_repository(spark, rows):
    dataset = spark.createDataFrame(
        [("o/a", "s1", 12, 1, 1), ("o/b", "s2", 12, 7, 2), ("o/a", "s3", 12, 9, 3), ("o/a", "s4", None, 4, 4)],
        "repo string, after_commit string, pr_number long, n_files long, n_modules long",
    )
    judged = spark.createDataFrame(
        [(1, "x", True, "o/b", None, 12), (2, "x", True, "o/a", "zz", 12), (3, "x", True, "o/a", "s4", 12), (4, "x", True, "o/c", "s1", 12)],
        "id long, judgment string, pass_tests boolean, repo string, sha string, pr_number long",
    )
    got = rows(evaluation.with_dataset(judged, dataset), "id", "n_files", "matched")
    assert got == [(1, 7, True), (2, 1, True), (3, 4, True), (4, None, False)]


def test_every_repository_has_a_version(spark, rows):
    files = spark.createDataFrame([(1, ".sdkmanrc", "java=\t1.8"), (2, "README", "x")], "repo_id long, path string, content string")
    repos = spark.createDataFrame([(1,), (2,), (3,)], "repo_id long")
    assert rows(buildconf.java_versions(repos, files)) == [(1, "8"), (2, "24"), (3, "24")]


def test_a_strict_report_fails_where_its_results_are_not_read(spark):
    coverage = spark.createDataFrame(
        [(1, "original", "T", "failed", "A", "1-3")], "commit_id long, version string, test_path string, result string, file string, covered_lines string"
    )
    changed = spark.createDataFrame([(1, "original", "A", 2)], "commit_id long, version string, file string, line_no int")
    assert changes.covering_tests(changed, coverage).count() == 1
    with pytest.raises(Exception, match="failed test: T"):
        changes.covering_tests(changed, changes.require_passed(coverage)).collect()


def test_only_complete_and_successful_commits_are_measured(spark, rows):
    settings = measurement.TestSettings(runs=3)

    def log(commit, version, run, last="[INFO] BUILD SUCCESS"):
        test = "[INFO] Tests run: 1, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: 1 s - in T"
        return [(commit, version, run, 1, test), (commit, version, run, 2, last)]

    both = [(v, r) for v in ("original", "patched") for r in (1, 2, 3)]
    lines = [x for v, r in both for x in log(1, v, r)]
    lines += [x for v, r in both for x in log(2, v, r, "BUILD FAILURE" if (v, r) == ("original", 1) else "BUILD SUCCESS")]
    lines += [x for v, r in both[:-1] for x in log(3, v, r)]
    df = spark.createDataFrame(lines, "commit_id long, version string, run_no long, line_no long, line string")
    assert rows(measured.measured_commits(df, settings), "commit_id") == [(1,)]
    assert rows(measured.commit_improvement(df, settings), "commit_id") == [(1,)]


def test_a_compile_error_may_begin_on_the_line_before(spark):
    logs = {
        1: ["[ERROR] ", "", "  COMPILATION ERROR : x"],
        2: ["[ERROR] ", "other", "COMPILATION ERROR : x"],
        3: ["[ERROR]x", "COMPILATION ERROR : x"],
        4: ["COMPILATION ERROR : x", "[error]"],
        5: ["[error]", "Fatal error compiling"],
    }
    rows = [(c, "original", 1, n, line) for c, lines in logs.items() for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "commit_id long, version string, run_no long, line_no long, line string")
    got = {r.commit_id: r.compile_error for r in measurement.log_outcomes(df).collect()}
    whole = re.compile(r"^\[ERROR\]\s+(COMPILATION ERROR|Fatal error compiling\b)", re.I | re.M)
    assert got == {c: bool(whole.search("\n".join(lines))) for c, lines in logs.items()} and sum(got.values()) == 2


# --- diffs --------------------------------------------------------------------------

PATCH = """--- a/x/A.java\t2026
+++ b/x/A.java\t2026
@@ -10,4 +10,5 @@ class A
 one
-two
+2
+zwei
 three
@@ -40 +41 @@
-four
+4
\\ No newline at end of file
--- a/B.java
+++ b/B.java
@@ -1,0 +1,1 @@
+first
@@ broken
+second""".split("\n")


@pytest.mark.parametrize("chunk", [3, 10**6, None])
def test_line_numbers_and_files(spark, chunk):
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(PATCH)], "patch_id long, seq long, line string")
    got = {tuple(r) for r in changes.numbered_lines(df, chunk=chunk).select("seq", "version", "line_no").collect()}
    assert got == {
        (4, "original", 11), (5, "patched", 11), (6, "patched", 12), (9, "original", 40), (10, "patched", 41),
        (15, "patched", 1), (17, "patched", 2),
    }
    files = {r["seq"]: r["file"] for r in changes.with_current_file(df, chunk=chunk).collect()}
    assert files[0] is None and files[5] == "x/A.java" and files[17] == "B.java"


def test_nearest_modules(spark, rows):
    files = spark.createDataFrame([("s", "a/b/src/X.java"), ("s", "a/Y.java"), ("s", "Z.java"), ("s", "q/W.java")], "sha string, path string")
    poms = spark.createDataFrame([("a",), ("a/b",), (".",)], "dir string")
    got = changes.nearest_modules(files, poms)
    assert rows(got, "path", "module") == sorted([("a/b/src/X.java", "a/b"), ("a/Y.java", "a"), ("Z.java", "."), ("q/W.java", ".")], key=repr)
    assert rows(changes.nearest_modules(files, poms.where("dir = 'a/b'")), "path", "module") == [("a/b/src/X.java", "a/b")]


def test_failed_test_fails_the_strict_job(spark):
    df = spark.createDataFrame([(1, "original", "t", "FAILED")], "commit_id long, version string, test_path string, result string")
    assert changes.failed_tests(df).count() == 1
    with pytest.raises(Exception, match="failed test: t"):
        changes.require_passed(df).collect()


def test_both_durations_strict(spark, rows):
    tests = spark.createDataFrame([(1, "a"), (1, "b")], "commit_id long, test_path string")
    times = spark.createDataFrame([(1, "original", "a", 1.0), (1, "patched", "a", 2.0), (1, "original", "b", 3.0)], "commit_id long, version string, test_path string, duration double")
    assert rows(changes.both_durations(tests, times), "test_path", "original", "patched") == [("a", 1.0, 2.0), ("b", 3.0, None)]
    with pytest.raises(Exception, match="no result of both versions: b"):
        changes.both_durations(tests, times, strict=True).collect()


# --- file limits -----------------------------------------------------------------------


def test_file_limits(spark, rows):
    files = spark.createDataFrame(
        [("big", f"F{i}.java", "M") for i in range(2000)] + [("ok", f"F{i}.java", "M") for i in range(20)] + [("over", f"F{i}.java", "M") for i in range(21)] + [("test", "ATest.java", "M")],
        "sha string, path string, status string",
    )
    commits = spark.createDataFrame([("big",), ("ok",), ("over",), ("test",), ("none",)], "sha string")
    assert rows(mining.within_file_limit(commits, files)) == [("none",), ("ok",), ("test",)]
    assert rows(mining.only_plain_java(commits, files)) == [("big",), ("none",), ("ok",), ("over",)]
    assert rows(mining.with_fitting_files(commits, files)) == [("none",), ("ok",)]
    kept = mining.files_of_small_commits(files)
    assert rows(kept.groupBy("sha").count()) == [("ok", 20), ("test", 1)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


# --- upsert ----------------------------------------------------------------------------

SCHEMA = "repo string, after_commit string, issue_number long, exec_status string"


def test_upsert(spark, rows):
    old = spark.createDataFrame([("r", "a", 1, "s"), ("r", "a", 2, None), ("r", "b", 3, "t")], SCHEMA)
    new = spark.createDataFrame([("r", "a", None, "u"), ("r", "c", 5, None), (None, "d", 6, "v")], SCHEMA)
    merged = dataset.upsert(old, new)
    expected = sorted([("r", "a", 1, "u"), ("r", "a", 2, "u"), ("r", "b", 3, "t"), ("r", "c", 5, None)], key=repr)
    assert rows(merged) == expected
    assert rows(dataset.upsert(merged, new)) == expected


def test_newest_values(spark, rows):
    new = spark.createDataFrame([("r", "a", 1, None, 1), ("r", "a", None, "x", 2), ("r", "a", None, None, 3)], SCHEMA + ", seq int")
    assert rows(dataset.newest_values(new, "seq")) == [("r", "a", 1, "x")]


# --- published figures -------------------------------------------------------------------


def test_judgement_tally(spark):
    counts = {"Exact Match": 9, "Semantic Equivalence": 4, "Correct Location": 25, "Off": 20, "N/A": 33}
    df = spark.createDataFrame([(i, j) for j, n in counts.items() for i in range(n)], "id int, judgment string")
    got = {r["judgment"]: r["n"] for r in evaluation.judgement_tally(df).collect()}
    assert got == {**counts, "Partial Improvement": 0, "ALL": 91}


def test_slice_shares(spark):
    counts = {"Exact Match": 9, "Semantic Equivalence": 4, "Correct Location": 25, "Off": 20, "N/A": 33}
    judgments = [j for j, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame([(j, i < 7, 1, 2) for i, j in enumerate(judgments)], "judgment string, pass_tests boolean, n_files int, n_modules int")
    got = {r["slice"]: r for r in evaluation.slice_table(df).collect()}
    whole = got["all"]
    assert (whole["n"], whole["generated"], whole["location"], whole["semantic"], whole["passing"]) == (91, 58, 38, 13, 7)
    assert (whole["generated_pct"], whole["location_pct"], whole["semantic_pct"], whole["passing_pct"]) == (63.7, 41.8, 14.3, 7.7)
    made = got["generated"]
    assert (made["generated_pct"], made["location_pct"], made["semantic_pct"], made["passing_pct"]) == (100.0, 65.5, 22.4, 12.1)
    assert "multi_file" not in got and got["single_file"]["n"] == 91


def test_detector_and_samples(spark):
    sample = [(True, True)] + [(False, True)] * 2 + [(False, False)] * 47
    quality = evaluation.detector_quality(spark.createDataFrame(sample, "detected boolean, truth boolean")).first()
    assert (quality["tp"], quality["fp"], quality["fn"], quality["tn"]) == (1, 0, 2, 47)
    assert quality["precision"] == 1.0 and quality["recall"] == pytest.approx(1 / 3)
    share = evaluation.confirmed_share(spark.createDataFrame([("yes",)] * 48 + [("no",)] * 2, "a string"), F.col("a") == "yes").first()
    assert tuple(share) == (48, 50, 0.96)
    flags = [(f"o/r{i}", i < 43) for i in range(194)]
    assert tuple(evaluation.flag_share(spark.createDataFrame(flags + flags[:35], "repo string, flag boolean")).first()) == (43, 194)


def test_star_buckets_cover_the_range_once(spark):
    edges = sorted({b + d for b in reports.STAR_BINS for d in (-1, 0, 1)})
    df = spark.createDataFrame([(e,) for e in edges], "stars long").withColumn("bucket", reports.star_bucket(F.col("stars")))
    for stars, bucket in df.collect():
        inside = [label for low, high, label in zip(reports.STAR_BINS, reports.STAR_BINS[1:], reports.STAR_LABELS) if low <= stars < high]
        assert ([bucket] if bucket else []) == inside


# --- measurement and outcomes --------------------------------------------------------------


def test_sign_test_is_symmetric_without_margin(spark):
    rng = random.Random(3)
    pairs = [(1, c, r, rng.choice([1.0, 2.0, 3.0]), rng.choice([1.0, 2.0, 3.0])) for c in ("A", "B") for r in range(2, 32)]
    settings = measurement.TestSettings(min_improvement=0.0)
    straight = spark.createDataFrame(pairs, "commit_id long, test_class string, run_no long, original double, patched double")
    swapped = straight.select("commit_id", "test_class", "run_no", F.col("patched").alias("original"), F.col("original").alias("patched"))
    one = {r["test_class"]: r for r in measurement.with_p_values(measurement.class_signs(straight, settings)).collect()}
    two = {r["test_class"]: r for r in measurement.with_p_values(measurement.class_signs(swapped, settings)).collect()}
    assert one.keys() == {"A", "B"}
    for name in one:
        assert one[name]["p_value"] == pytest.approx(two[name]["reverse_p_value"])
        assert one[name]["reverse_p_value"] == pytest.approx(two[name]["p_value"])


def test_incomplete_and_quick_classes_are_left_out(spark, rows):
    pairs = [(1, c, r, 1.0, 0.5) for c in ("full", "quick", "short") for r in range(2, 32) if not (c == "short" and r == 9)]
    pairs = [(a, c, r, 0.009 if c == "quick" and r == 5 else o, p) for a, c, r, o, p in pairs]
    df = spark.createDataFrame(pairs, "commit_id long, test_class string, run_no long, original double, patched double")
    verdicts = measurement.with_verdict(measurement.with_p_values(measurement.class_signs(df)))
    assert rows(verdicts, "test_class", "verdict") == [("full", measurement.IMPROVED)]


def test_outcomes_fold_in_run_order(spark, rows):
    logs = [
        (1, "original", 1, True, False), (1, "patched", 1, True, False),
        (2, "original", 1, True, False), (2, "patched", 1, False, True), (2, "patched", 2, False, False),
        (3, "original", 1, False, False), (4, "patched", 2, False, False), (4, "original", 2, True, False),
        *((7, version, run, True, False) for version in ("original", "patched") for run in (1, 2)),
        *((8, version, run, True, False) for version, run in (("original", 1), ("patched", 1), ("original", 2), ("patched", 3))),
    ]
    outcomes = spark.createDataFrame(logs, "commit_id long, version string, run_no long, build_ok boolean, compile_error boolean")
    candidates = spark.createDataFrame([(i, i != 5) for i in range(1, 9)], "commit_id long, patch_applicable boolean")
    got = rows(evaluation.fold_outcomes(candidates, outcomes), "commit_id", "compile_success", "test_success", "setup_error")
    assert got == [
        (1, None, None, True), (2, False, False, False), (3, True, False, True), (4, True, False, False),
        (5, False, False, False), (6, None, None, True), (7, True, True, False), (8, None, None, True),
    ]
    # with one run each, the first candidate has all its logs
    one = evaluation.fold_outcomes(candidates, outcomes, settings=measurement.TestSettings(runs=1))
    assert rows(one.where("commit_id = 1"), "compile_success", "test_success", "setup_error") == [(True, True, False)]


def test_task_and_diff_texts(spark):
    df = spark.createDataFrame([("o/r", "T", None, ["m1", "m2"], ["a", "b"])], "repo string, title string, body string, modified_modules array<string>, changed_files array<string>")
    text = "{repo-name}|{issue-title}|{issue-description}|{buggy-module}|{buggy-files}"
    assert tasks.task_texts(df, text).first()["task"] == "r|T||m1,m2|a\nb"
    files = spark.createDataFrame([("s", 2, "b", "P2"), ("s", 1, "a", "P1"), ("s", 3, "c", None)], "sha string, position int, path string, patch string")
    assert tasks.commit_diffs(files).first()["diff"] == "--- a\nP1\n--- b\nP2\n"


def plain_diff(lines):
    """(position, version, file, line_no) of a patch, hunk by hunk."""
    out, old, new, left_old, left_new, old_file, new_file = [], 0, 0, 0, 0, None, None
    for at, line in enumerate(lines):
        if left_old > 0 or left_new > 0:
            if line[:1] == "-":
                out.append((at, "original", old_file or new_file, old))
            if line[:1] == "+":
                out.append((at, "patched", new_file or old_file, new))
            old, left_old = old + (line[:1] in "- "), left_old - (line[:1] in "- ")
            new, left_new = new + (line[:1] in "+ "), left_new - (line[:1] in "+ ")
        elif head := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            old, left_old, new, left_new = (int(x) if x is not None else 1 for x in head.groups())
        elif line.startswith("--- "):
            old_file = None if "/dev/null" in line else line[6:]
        elif line.startswith("+++ "):
            new_file = None if "/dev/null" in line else line[6:]
    return out


def made_patch(rng):
    lines = []
    for n in range(rng.randint(1, 4)):
        created, deleted = rng.random() < 0.2, rng.random() < 0.2
        lines += ["diff --git a/x b/x", "--- /dev/null" if created else f"--- a/old{n}", "+++ /dev/null" if deleted and not created else f"+++ b/new{n}"]
        for _ in range(rng.randint(0, 3)):
            body = [rng.choice("-+ ") + rng.choice(["x", "-- a/trap", "++ b/trap", "", "@@ -1,1 +1,1 @@"]) for _ in range(rng.randint(1, 9))]
            old, new = (sum(b[0] in side for b in body) for side in ("- ", "+ "))
            size = lambda k: "" if k == 1 and rng.random() < 0.5 else f",{k}"
            lines += [f"@@ -{rng.randint(0, 50)}{size(old)} +{rng.randint(0, 50)}{size(new)} @@ f()", *body]
            if rng.random() < 0.3:
                lines.append("\\ No newline at end of file")
        if rng.random() < 0.3:
            lines += ["-- ", "2.43.0", "+ signature"]
    return lines


@pytest.mark.parametrize("chunk", [1, 3, 7, 1_000_000, None])
def test_strict_diff_equals_a_plain_parser(spark, chunk):
    rng = random.Random(chunk or 0)
    patches = [made_patch(rng) for _ in range(25)] + [["--- a/f", "+++ b/f", "@@ -1,2 +1,1 @@", "--- x", " y", "--- z"]]
    df = spark.createDataFrame([(k, at, line) for k, p in enumerate(patches) for at, line in enumerate(p)], "patch_id long, seq long, line string")
    got = sorted(tuple(r) for r in changes.changed_lines_by_file(df, chunk=chunk).collect())
    assert got == sorted((k, *row) for k, p in enumerate(patches) for row in plain_diff(p))
    assert (25, 3, "original", "f", 1) in got and not [r for r in got if r[:2] == (25, 5)]


def test_changed_lines_by_file_agrees_with_the_lenient_numbers(spark):
    lines = ["+++ b/f", "@@ -3,2 +5,2 @@", "-a", "--- b", "+c", "+++ g", "+d", "tail", "+e"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "patch_id long, seq long, line string")
    lenient = changes.changed_lines_by_file(df, strict_diff=False)
    assert sorted(map(tuple, lenient.drop("file").collect())) == sorted(map(tuple, changes.numbered_lines(df).collect()))
    assert {r.seq: r.file for r in lenient.collect()} == {2: "f", 4: "f", 6: "g", 8: "g"}


@given(st.lists(st.tuples(st.integers(0, 70), st.integers(-2, 40)), max_size=12), st.sets(st.integers(0, 120), max_size=20))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_interval_join_finds_what_lines_find(spark, ranges, lines):
    text = ",".join(f"{a}-{a + w}" for a, w in ranges) or " "
    coverage = spark.createDataFrame([(1, "patched", "T", "f", text), (1, "patched", "U", "other", "1-9")], "commit_id long, version string, test_path string, file string, covered_lines string")
    changed = spark.createDataFrame([(1, "patched", "f", n) for n in lines], "commit_id long, version string, file string, line_no long")
    got = sorted(r.line_no for r in changes.changed_and_covered(changed, coverage).collect())
    assert got == sorted(n for a, w in ranges for n in range(a, a + w + 1) if n in lines)


def test_a_huge_range_stays_one_row(spark):
    coverage = spark.createDataFrame([(1, "patched", "T", "f", "5,1-2000000000,7-7")], "commit_id long, version string, test_path string, file string, covered_lines string")
    changed = spark.createDataFrame([(1, "patched", "f", n) for n in (1, 5, 7, 1_999_999_999, 2_000_000_001)], "commit_id long, version string, file string, line_no long")
    hits = changes.changed_and_covered(changed, coverage)
    assert sorted(r.line_no for r in hits.collect()) == [1, 5, 5, 7, 7, 1_999_999_999]
    assert "sequence(" not in hits._jdf.queryExecution().toString()

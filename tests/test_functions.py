"""Column expressions on hand-made values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine.functions import cells, links, logtext, paths, refs
from perfmine.operators import buildconf, pressure


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, numbers",
    [
        ("Fixes #123", {123}),
        ("Closes #456 and resolves #789", {456, 789}),
        ("Fix GH-123", {123}),
        ("Resolves owner/repo#456", {456}),
        ("Resolves Owner/Repo#456", {456}),
        ("Fixes https://github.com/OWNER/repo/issues/7", {7}),
        ("Fixes https://github.com/other/repo/issues/7", set()),
        ("fixed: issue #4, bug #5 & gh-6 or #7 | #8", {4, 5, 6, 7, 8}),
        ("HAL-2028: fix attribute processing", {2028}),
        ("Issue: [HAL-2028]", {2028}),
        ("see [ab-12] here", {12}),
        ("prefix #3", set()),
        ("hotfix #3", set()),
        ("Fixes #0", set()),
        ("mentions #5 only", set()),
        ("Fixes #99999999999999999999", set()),
        ("utf-8, done", {8}),
        ("Fixes other/repo#9", {9}),
        ("line one\nHAL-3\nline", {3}),
        (None, set()),
    ],
)
def test_references(spark, text, numbers):
    got = values(spark, lambda c: refs.fixed_refs(c, F.lit("owner/repo")), [text])[0]
    assert set(got) == numbers


def test_strict_repo_excludes_foreign_references(spark):
    texts = ["Fixes other/repo#9", "Fixes owner/repo#9", "Fixes #9", "Fixes issue #9", "Fixes gh-9"]
    got = values(spark, lambda c: refs.closing_refs(c, F.lit("owner/repo"), True), texts)
    assert [list(g) for g in got] == [[], [9], [9], [9], [9]]


def test_test_lines(spark):
    head = "[INFO] Tests run: 9, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: "
    texts = [
        head + "0.098 s - in org.a.B", head + "621 ms -- in org.a.C", head + "2 min - in D ", head + "1.5 h -- in E",
        head.replace("[INFO]", "[WARNING]") + "1 s - in F", head + "1 day - in G",
    ]
    assert values(spark, logtext.test_class, texts) == ["org.a.B", "org.a.C", "D", "E", None, None]
    assert values(spark, logtext.test_seconds, texts) == [0.098, 0.621, 120.0, 5400.0, None, None]


def test_total_time(spark):
    texts = ["1.234 s", "01:23 min", "2 min", "1:23:45 h", "1:30 h", "2 h", "9 fortnights", "x"]
    got = values(spark, logtext.total_time_seconds, texts)
    assert got == [1.234, 83.0, 120.0, 5025.0, 5400.0, 7200.0, 9.0, None]
    assert values(spark, logtext.total_time_text, ["a\n[INFO] total TIME:  5 s \nTotal time: 6 s"]) == ["5 s"]


def test_covered_lines(spark):
    got = values(spark, logtext.covered_lines, ["8,16,19-21", "9-5,3, ,3", "", "2-2"])
    assert [list(g) for g in got] == [[8, 16, 19, 20, 21], [3], [], [2]]


def test_clock_difference(spark):
    df = spark.createDataFrame([("23:59:59,500", "00:00:01,7"), ("10:00:00,1", "10:00:00,25")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(logtext.clock_difference(F.col("a"), F.col("b"))).collect()]
    assert got == [2.2, 0.15]


def test_name_status(spark):
    lines = ["M\ta", "D\ta", "A\ta", "R100\ta\tb", "C75\ta\tb", "R100\ta", "T\ta", "M", "", "R\ta"]
    got = values(spark, paths.change_record_of_line, lines)
    assert [tuple(g) if g else None for g in got] == [
        ("a", "a"), ("a", None), (None, "a"), ("a", "b"), ("a", "b"), None, (None, "a"), None, None, (None, "a"),
    ]


def test_paths(spark):
    files = ["a/B.java", "a/B.JAVA", "src/test/B.java", "generated/B.java", "Latest.java", "a/B.xml"]
    assert values(spark, paths.is_plain_java, files) == [True, False, False, True, False, False]
    assert values(spark, paths.is_java_source, files) == [True, True, False, False, False, False]
    assert values(spark, paths.is_java_test, files) == [False, False, True, False, False, False]
    assert values(spark, paths.folder, ["a/b/C.java", "C.java"]) == ["a/b", ""]


def test_links(spark):
    repos = ["owner/name", "a/b/c", "OTHERS", "plain", None]
    assert values(spark, links.short_label, repos) == ["name", "b/c", "Others", "plain", "Unknown"]
    sha = "0123456789abcdef0123456789abcdef01234567"
    keys = [f"ab__c-d_{sha}", f"ab__c_d_{sha}", f"ab_c-d_{sha}", "x-y-1234567_bak"]
    got = [tuple(g) for g in values(spark, links.decode_path_key, keys)]
    assert got == [("ab/c-d", sha), ("ab/c_d", sha), (None, None), (None, None)]
    got = values(spark, links.commit_link, [f"https://github.com/o/r/commit/{sha}", "nothing"])
    assert [tuple(g) for g in got] == [("o", "r", sha), (None, None, None)]
    assert tuple(values(spark, links.pull_link, ["https://github.com/o/r/pull/17/changes"])[0]) == ("o/r", 17)


def test_java_majors(spark):
    texts = ["17", "17.0.7", "1.8", "temurin-17.0.9", "${java.version}", "", None, "1.x8"]
    assert values(spark, buildconf.major_version, texts) == ["17", "17", "8", "17", None, None, None, "1"]


def test_property_expansion_is_one_pass(spark):
    props = F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("9"))
    got = values(spark, lambda c: buildconf.expand(c, props), ["${a}-${b}-${c}", "plain", "${b}"])
    assert got == ["${b}-9-${c}", "plain", "9"]


def test_java_version_precedence(spark, rows):
    pom = "<project xmlns='http://x/y'><properties><java.version>${v}</java.version><v> 1.8 </v></properties></project>"
    plugin = (
        "<project><build><plugins><plugin><artifactId>other</artifactId><configuration><release>3</release></configuration></plugin>"
        "<plugin><artifactId>maven-compiler-plugin</artifactId><configuration><source>11</source></configuration></plugin></plugins></build></project>"
    )
    files = [
        (1, "pom.xml", pom), (2, "pom.xml", plugin), (3, "pom.xml", "<project><broken"), (3, ".java-version", "\n temurin-17.0.9 x"),
        (4, ".sdkmanrc", "# java=5\n  java=19.0.1-tem\njava=20"), (5, "README", "17"), (6, "pom.xml", pom), (6, ".mvn/jvm.config", "-X --source 7 --target=6"),
    ]
    df = spark.createDataFrame(files, "repo_id long, path string, content string")
    assert rows(buildconf.java_versions(df.select("repo_id"), df)) == [(1, "8"), (2, "11"), (3, "17"), (4, "19"), (5, "24"), (6, "6")]


def test_pressure_line(spark):
    line = "some avg10=0.00 avg60=1.50 avg300=12.25 total=48940356567"
    df = spark.createDataFrame([(0, "f", line), (1, "f", "full avg10=99.0 avg60=1 avg300=1")], "seq long, file string, line string")
    parsed = pressure.samples(df)
    assert parsed.first()["pressure"] == {"avg10": 0.0, "avg60": 1.5, "avg300": 12.25}
    assert [tuple(r) for r in pressure.exceeded(parsed).collect()] == [(0, "f", "avg300", 12.25)]


LIST = T.ArrayType(T.StringType())
MAP = T.MapType(T.StringType(), LIST)


def test_cells(spark):
    texts = ['["a"]', "['a']", '"[""a""]"', '"[\\"a\\"]"', '["a"]"', "x", "", None, '{"a": 1}', "['a', None]", "'\"[\\'a\\']\"'"]
    got = values(spark, lambda c: cells.decode_cell(c, LIST), texts)
    assert got == [["a"], ["a"], ["a"], ["a"], ["a"], None, None, None, None, ["a", None], ["a"]]
    odd = ["[b'x']", "['a', {1, 2}]", '["a"] junk', '["a"]["b"]', '["a"], ["b"]', '[""a"", None]', "[[]]", "{'a': 1}", "[" * 300]
    assert [list(g) if g else g for g in values(spark, lambda c: cells.decode_cell(c, LIST), odd)] == [None, None, None, None, None, ["a", None], ["[]"], None, None]
    odd = ["{(1, 2): ['a']}", "{[]: 1}", '{""a"": None}', '{\\"a\\": None}', '{"a": ["x"]} junk']
    assert values(spark, lambda c: cells.decode_cell(c, MAP), odd) == [None, None, {"a": None}, {"a": None}, None]
    got = values(spark, lambda c: cells.decode_cell(c, MAP), ['{"k": ["a", "b"]}', "{'k': []}", '["a"]'])
    assert got == [{"k": ["a", "b"]}, {"k": []}, None]
    assert values(spark, cells.whole_number, ["7", "7.0", "7.5", "x", "", None, "1e3"]) == [7, 7, None, None, None, None, 1000]

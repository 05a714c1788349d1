"""Diffs, changed files, modules and test coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.functions import logtext, paths, scan
from perfmine.session import staged

# The header of a hunk and of the new file in a unified diff.
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NEW_FILE = r"^\+\+\+ (?:b/)?([^\t]+)"
OLD_FILE = r"^--- (?:a/)?([^\t]+)"
NO_FILE = "/dev/null"
VERSIONS = ("original", "patched")


def changed_in_place(files: DataFrame) -> DataFrame:
    """FLT-08: files whose path the change keeps; ``record`` is their change record."""
    return files.where(paths.is_in_place(F.col("record")))


def java_sources(files: DataFrame) -> DataFrame:
    """FLT-06."""
    return files.where(paths.is_java_source(F.col("path")))


def java_tests(files: DataFrame) -> DataFrame:
    """FLT-07."""
    return files.where(paths.is_java_test(F.col("path")))


def numbered_lines(lines: DataFrame, keys=("patch_id",), position: str = "seq", chunk: int | None = None) -> DataFrame:
    """SC-10 / W-04: added and removed lines with their number in the new or old file.

    A context line moves both counters, ``---`` and ``+++`` lines and any other
    text move none. Lines before the first hunk count from zero. The counters
    are chunked running sums, so one huge patch is shared by many tasks. The
    text is read once; the scans work on a staged table of line kinds, cut into
    chunks of about equally many lines, so ``position`` may have gaps of any width.
    """
    line = F.col("line")
    is_hunk = line.rlike(HUNK_HEADER)
    other = line.startswith("@@")
    removed = ~other & line.startswith("-") & ~line.startswith("---")
    added = ~other & line.startswith("+") & ~line.startswith("+++")
    context = line.startswith(" ")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    kind = F.when(is_hunk, "hunk").when(removed, "removed").when(added, "added").when(context, "context")

    def first_line(group: int) -> Column:
        return F.when(is_hunk, F.regexp_extract(line, HUNK_HEADER, group).try_cast("bigint"))

    kinds = scan.cut(
        lines.select(
            *keys, position, kind.alias("kind"), first_line(1).alias("_old_start"), first_line(3).alias("_new_start")
        ).where(F.col("kind").isNotNull()),
        list(keys),
        position,
        chunk,
    )
    kind = F.col("kind")
    based = scan.running(
        kinds,
        list(keys),
        position,
        sums={
            "_old": F.when(kind.isin("removed", "context"), one).otherwise(zero),
            "_new": F.when(kind.isin("added", "context"), one).otherwise(zero),
        },
        anchors={"_old_base": (F.col("_old_start"), "_old"), "_new_base": (F.col("_new_start"), "_new")},
    )
    number = F.when(kind == "removed", F.coalesce("_old_base", zero) + F.col("_old") - 1).otherwise(
        F.coalesce("_new_base", zero) + F.col("_new") - 1
    )
    return based.where(kind.isin("removed", "added")).select(
        *keys,
        position,
        F.when(kind == "removed", F.lit(VERSIONS[0])).otherwise(F.lit(VERSIONS[1])).alias("version"),
        number.alias("line_no"),
    )


def with_current_file(
    lines: DataFrame, keys=("patch_id",), position: str = "seq", chunk: int | None = None
) -> DataFrame:
    """W-08: the file each line of a multi-file patch belongs to."""
    path = F.nullif(F.regexp_extract("line", NEW_FILE, 1), F.lit(""))
    return scan.running(scan.cut(lines, list(keys), position, chunk), list(keys), position, lasts={"file": path})


def changed_lines_by_file(
    lines: DataFrame, keys=("patch_id",), position: str = "seq", strict_diff: bool = True, chunk: int | None = None
) -> DataFrame:
    """SC-10 and W-08 together: (keys, position, version, file, line_no) of every added and removed line.

    With ``strict_diff`` a hunk is as long as its header says: a line in it that
    begins with ``---`` or ``+++`` is a removed or added line, and one behind its
    end is none. Until a hunk has ended each of its lines moves the counters by its
    first character, so how many old and new lines came before tells whether it has;
    a running sum and its value at the header are enough. Without ``strict_diff``
    such lines are headers, as in ``numbered_lines``. The file of a removed line is
    the old one, that of an added line the new one; a created or deleted file has
    one name. A patch that names no file has a null file.
    """
    line = F.col("line")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    is_hunk = F.col("_is_hunk")

    def header(group: int) -> Column:
        return F.when(is_hunk, F.regexp_extract(line, HUNK_HEADER, group).try_cast("bigint"))

    def length(group: int) -> Column:
        # a header without a length means one line
        return F.when(is_hunk, F.coalesce(header(group), one))

    def path(pattern: str, start: str) -> Column:
        return F.when(line.startswith(start), F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")))

    first = F.substring("line", 1, 1)
    wanted = scan.cut(
        lines.where(first.isin("@", "-", "+", " "))
        # a column of its own, so that the pattern is tried once
        .select(*keys, position, "line", (line.startswith("@@ -") & line.rlike(HUNK_HEADER)).alias("_is_hunk"))
        .select(
            *keys,
            position,
            F.when(is_hunk, "@").when(first != "@", first).alias("_kind"),
            (line.startswith("---") | line.startswith("+++")).alias("_like_header"),
            header(1).alias("_old_start"),
            header(3).alias("_new_start"),
            length(2).alias("_old_lines"),
            length(4).alias("_new_lines"),
            path(OLD_FILE, "--- ").alias("_old_name"),
            path(NEW_FILE, "+++ ").alias("_new_name"),
        ),
        list(keys),
        position,
        chunk,
    )
    kind = F.col("_kind")
    mark = F.lit(False) if strict_diff else F.col("_like_header")
    old_step = F.when(kind.isin("-", " ") & ~mark, one).otherwise(zero)
    new_step = F.when(kind.isin("+", " ") & ~mark, one).otherwise(zero)
    at_header = F.when(kind == "@", zero)
    counted = scan.running(
        wanted,
        list(keys),
        position,
        sums={"_old": old_step, "_new": new_step},
        lasts={"_old_length": F.col("_old_lines"), "_new_length": F.col("_new_lines")},
        anchors={
            "_old_base": (F.col("_old_start"), "_old"),
            "_new_base": (F.col("_new_start"), "_new"),
            # the sums at the header, negated
            "_old_before": (at_header, "_old"),
            "_new_before": (at_header, "_new"),
        },
        keep_chunk=True,
    )
    # what the hunk has had before this line, against what its header says
    had_old = F.col("_old") - old_step + F.col("_old_before")
    had_new = F.col("_new") - new_step + F.col("_new_before")
    unfinished = F.coalesce((had_old < F.col("_old_length")) | (had_new < F.col("_new_length")), F.lit(False))
    inside = (unfinished & (kind != "@")) if strict_diff else (kind.isin("-", "+", " ") & ~F.col("_like_header"))
    # read by both halves of the next scan
    marked = staged(counted.select(*keys, position, "_chunk", "_kind", "_old", "_new", "_old_base", "_new_base", "_old_name", "_new_name", inside.alias("_inside")), "marked")
    named = scan.running(
        marked,
        list(keys),
        position,
        lasts={
            "_old_file": F.when(~F.col("_inside"), F.col("_old_name")),
            "_new_file": F.when(~F.col("_inside"), F.col("_new_name")),
        },
    )
    removed = kind == "-"
    number = F.when(removed, F.coalesce("_old_base", zero) + F.col("_old") - 1).otherwise(F.coalesce("_new_base", zero) + F.col("_new") - 1)
    old, new = (F.nullif(F.col(c), F.lit(NO_FILE)) for c in ("_old_file", "_new_file"))
    return named.where(F.col("_inside") & kind.isin("-", "+")).select(
        *keys,
        position,
        F.when(removed, F.lit(VERSIONS[0])).otherwise(F.lit(VERSIONS[1])).alias("version"),
        F.when(removed, F.coalesce(old, new)).otherwise(F.coalesce(new, old)).alias("file"),
        number.alias("line_no"),
    )


def nearest_modules(files: DataFrame, poms: DataFrame, keys=("sha",), on=()) -> DataFrame:
    """JN-07 / W-07: the nearest ancestor directory with a build file, per file.

    A file without one is dropped. ``on`` names shared columns, such as the
    repository, that also must agree.
    """
    placed = files.select(*keys, *on, "path", paths.folder(F.col("path")).alias("_folder"))
    # a file's module is that of its folder, and folders are few
    steps = placed.select(*on, "_folder").distinct().withColumn("_a", F.explode(paths.ancestors(F.col("_folder"))))
    modules = (
        steps.select(*on, "_folder", F.col("_a.dir").alias("dir"), F.col("_a.depth").alias("depth"))
        .join(poms.select(*on, "dir").distinct(), [*on, "dir"])
        .groupBy(*on, "_folder")
        .agg(F.max_by("dir", "depth").alias("module"))
    )
    return placed.join(modules, [*on, "_folder"]).select(*keys, *on, "path", "module")


def module_and_file_rows(assigned: DataFrame, keys=("sha",)) -> DataFrame:
    """AG-24: the distinct modules and files of each key as rows (kind, name).

    A change of any size: nothing of it is gathered in one cell.
    """
    return (
        assigned.select(*keys, F.explode(F.array(_named("module"), _named("path", "file"))).alias("_n"))
        .select(*keys, "_n.kind", "_n.name")
        .distinct()
    )


def _named(column: str, kind: str | None = None) -> Column:
    return F.struct(F.lit(kind or column).alias("kind"), F.col(column).alias("name"))


def modules_and_files(assigned: DataFrame, keys=("sha",)) -> DataFrame:
    """AG-24 in list form, for commits whose number of files is bounded."""
    return assigned.groupBy(*keys).agg(
        F.array_sort(F.collect_set("module")).alias("modified_modules"),
        F.array_sort(F.collect_set("path")).alias("changed_files"),
    )


# --- coverage ------------------------------------------------------------------------


def coverage_rows(reports: DataFrame, keys=("commit_id", "version", "module")) -> DataFrame:
    """SRC-04 / SC-27: coverage reports as one row per (test, file).

    A test that covers nothing keeps one row with a null file.
    """
    tests = reports.select(*keys, F.explode("tests").alias("t"))
    by_path = tests.select(*keys, "t", F.explode_outer("t.paths").alias("p"))
    by_file = by_path.select(*keys, "t", F.col("p.path").alias("path"), F.explode_outer("p.files").alias("f"))
    module = F.col("module")
    named = (F.coalesce(F.col("f.fileName"), F.lit("")) != "") & (F.coalesce(F.col("f.coveredLines"), F.lit("")) != "")
    return by_file.select(
        *keys,
        paths.covered_path(module, "src/test/java/", F.lit(""), F.coalesce("t.uniformPath", F.lit(""))).alias("test_path"),
        F.upper(F.coalesce("t.result", F.lit(""))).alias("result"),
        F.coalesce("t.duration", F.lit(0.0)).alias("duration"),
        F.when(named, paths.covered_path(module, "src/main/java/", F.col("path"), F.col("f.fileName"))).alias("file"),
        F.when(named, F.col("f.coveredLines")).alias("covered_lines"),
    )


def failed_tests(coverage: DataFrame) -> DataFrame:
    """FLT-24: tests that did not pass; a valid report has none."""
    return coverage.where(F.upper("result") != "PASSED").select("commit_id", "version", "test_path").distinct()


def require_passed(coverage: DataFrame) -> DataFrame:
    """FLT-24, strict: the job fails on the first test that did not pass."""
    passed = F.upper("result") == "PASSED"
    message = F.concat(F.lit("failed test: "), F.col("test_path"))
    # a predicate: a column that nobody reads would be pruned, and its error with it
    return coverage.where(F.when(passed, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def covered_ranges(coverage: DataFrame) -> DataFrame:
    """The ranges of covered lines, one row each (first_line, last_line); reversed ones are empty."""
    part = F.trim("_part")
    return (
        coverage.withColumn("_part", F.explode(F.split("covered_lines", ",")))
        .where(part != "")
        .withColumn("first_line", F.trim(F.substring_index(part, "-", 1)).cast("int"))
        .withColumn("last_line", F.trim(F.substr(part, F.instr(part, "-") + 1)).cast("int"))
        .where(F.col("first_line") <= F.col("last_line"))
        .drop("covered_lines", "_part")
    )


def covered_line_rows(coverage: DataFrame) -> DataFrame:
    """SC-08 as rows: one per line of each covered range."""
    return covered_ranges(coverage).withColumn("line_no", F.explode(F.sequence("first_line", "last_line"))).drop("first_line", "last_line")


def changed_and_covered(changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """JN-08 / SET-04: covered lines that were changed, per version and test.

    A line that a text names twice comes twice.
    """
    hits = _changed_ranges(changed, coverage)
    columns = [c for c in hits.columns if c not in ("first_line", "last_line", "_cell", "_hit")]
    # the places of the cell that lie in the range
    first, last = F.greatest(F.col("first_line") - F.col("_cell") * 64, F.lit(0)), F.least(F.col("last_line") - F.col("_cell") * 64, F.lit(63))
    places = F.slice(F.array(*[F.lit(i) for i in range(64)]), first + 1, last - first + 1)
    found = hits.withColumn("_place", F.explode(places)).where("shiftright(_hit, _place) & 1 = 1")
    return found.select(*columns, (F.col("_cell") * 64 + F.col("_place")).alias("line_no"))


def _changed_ranges(changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """The covered ranges with a changed line, once for each cell of 64 lines where they have one.

    An interval join. The changed lines of a cell are the bits of one number
    (``_hit`` has those within the range), so few rows are sent. A range of up to 64
    lines lies in at most two cells. One of up to 2^k lines, k over 6, lies in at most
    two bins of 2^k lines, and the cells of its file look into their bin of each such
    width that the file's ranges have. So a range is sent to two places, however long
    it is. The key of the join has the bin: a file that many tests touch spreads over
    its bins. Coverage of files without a change, the bulk of a report, is left out first.
    """
    file = ["commit_id", "version", "file"]
    line = F.col("line_no").cast("int")
    # written: ``changed`` may be a long way from its input, and is read by each part of the join
    cells = staged(
        changed.where(line.isNotNull()).groupBy(*file, F.shiftright(line, 6).alias("_cell")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(line_no as int) & 63)")).alias("_lines")
        ),
        "cells",
    )
    touched = coverage.join(cells.select(*file).distinct(), file, "left_semi")
    length = F.col("last_line").cast("bigint") - F.col("first_line")

    def placed(rows: DataFrame, width: str, to: str) -> DataFrame:
        first, last = f"shiftright(first_line, {width})", f"shiftright(last_line, {width})"
        return rows.withColumn(to, F.explode(F.expr(f"if({first} = {last}, array({first}), array({first}, {last}))")))

    short = placed(covered_ranges(touched).where(length < 64), "6", "_cell").join(cells, [*file, "_cell"])
    # a long range ends at 64 or later; the text tells that without being taken apart
    may_be_long = touched.where(F.col("covered_lines").rlike(r"-[^,]*(?:6[4-9]|[7-9][0-9]|[0-9]{3})"))
    # the bits of (length - 1) are the least k with 2^k >= length
    long = covered_ranges(may_be_long).where(length >= 64).withColumn("_width", F.length(F.bin(length)))
    asked = cells.join(long.select(*file, "_width").distinct(), file).withColumn("_bin", F.expr("shiftright(_cell, _width - 6)"))
    long = placed(long, "_width", "_bin").join(asked, [*file, "_width", "_bin"]).drop("_width", "_bin")
    met = short.unionByName(long)
    # bits of the cell's lines that lie in the range
    inside = "shiftleft(-1L, greatest(first_line - _cell * 64, 0)) & shiftrightunsigned(-1L, 63 - least(last_line - _cell * 64, 63))"
    apart = (F.expr("shiftright(last_line, 6)") < F.col("_cell")) | (F.expr("shiftright(first_line, 6)") > F.col("_cell"))
    return met.where(~apart).withColumn("_hit", F.expr(f"_lines & {inside}")).where("_hit <> 0").drop("_lines")


def covering_tests(changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """AG-23 / SET-03: distinct tests that cover a change in either version."""
    return _changed_ranges(changed, coverage).select("commit_id", "test_path").distinct()


def without_modified_tests(tests: DataFrame, changed_tests: DataFrame) -> DataFrame:
    """FLT-25: drop tests whose file the commit changes."""
    file = F.concat(F.regexp_extract("test_path", r"^(.*)/[^/]*$", 1), F.lit(".java"))
    changed = changed_tests.select("commit_id", F.col("path").alias("_file")).distinct()
    return tests.withColumn("_file", file).join(changed, ["commit_id", "_file"], "left_anti").drop("_file")


def both_durations(tests: DataFrame, durations: DataFrame, strict: bool = False) -> DataFrame:
    """JN-09: durations of covering tests in both versions, one row per test.

    A missing side is null; with ``strict`` it fails the job.
    """
    on = ["commit_id", "test_path"]
    sides = durations.groupBy(*on).agg(
        *[F.max(F.when(F.col("version") == v, F.col("duration"))).alias(v) for v in VERSIONS]
    )
    joined = tests.join(sides, on, "left")
    if not strict:
        return joined
    missing = F.raise_error(F.concat(F.lit("no result of both versions: "), F.col("test_path")))
    return joined.select(*on, *[F.coalesce(F.col(v), missing.cast("double")).alias(v) for v in VERSIONS])


def total_durations(both: DataFrame) -> DataFrame:
    """AG-21: time of all covering tests, per version."""
    return both.groupBy("commit_id").agg(*[F.sum(v).alias(v) for v in VERSIONS])

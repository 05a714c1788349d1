"""From build-log lines to paired measurements and their sign tests.

Rows are keyed by the columns ``keys`` (one commit or candidate), ``version``
(``original`` or ``patched``) and ``run_no``. Everything is an aggregate that
combines before the shuffle; no group is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.functions import logtext, scan
from perfmine.functions.stats import count_losses, count_wins, relative_improvement, sign_tail
from perfmine.session import staged

COMMIT = ("commit_id",)
ORIGINAL, PATCHED = "original", "patched"


@dataclass(frozen=True)
class TestSettings:
    """Fixed values of the sign test and of the measurement protocol."""

    runs: int = 31
    first_run: int = 1
    min_improvement: float = 0.05
    max_p_value: float = 0.1
    noise_floor: float = 0.01
    __test__ = False  # not a pytest class


DEFAULT = TestSettings()


def test_times(lines: DataFrame) -> DataFrame:
    """SC-06: the test lines of logs as ``test_class`` and ``seconds``."""
    return (
        lines.where(F.contains("line", F.lit("Tests run:")))
        .withColumn("test_class", logtext.test_class(F.col("line")))
        .withColumn("seconds", logtext.test_seconds(F.col("line")))
        .where(F.col("test_class").isNotNull())
        .drop("line")
    )


test_times.__test__ = False


def last_time_per_class(times: DataFrame, keys=COMMIT) -> DataFrame:
    """AG-02 / W-03: within one log the last line of a class counts."""
    return times.groupBy(*keys, "version", "run_no", "test_class").agg(
        F.max_by("seconds", "line_no").alias("seconds")
    )


def run_totals(times: DataFrame, logs: DataFrame | None = None, keys=COMMIT) -> DataFrame:
    """AG-01: total test seconds per run; a log of ``logs`` without a test line has 0."""
    totals = times.groupBy(*keys, "version", "run_no").agg(F.sum("seconds").alias("total_seconds"))
    if logs is None:
        return totals
    wanted = logs.select(*keys, "version", "run_no").distinct()
    return wanted.join(totals, [*keys, "version", "run_no"], "left").withColumn(
        "total_seconds", F.coalesce("total_seconds", F.lit(0.0))
    )


def without_warmup(runs: DataFrame, settings: TestSettings = DEFAULT) -> DataFrame:
    """FLT-13: the first run warms up and is not measured."""
    return runs.where(F.col("run_no") > settings.first_run)


def paired(runs: DataFrame, by: list[str], value: str = "seconds") -> DataFrame:
    """JN-01 / JN-02: both versions of a run side by side.

    One conditional aggregate in place of a self join: the input is read and
    shuffled once. A side without a measurement is null.
    """
    return runs.groupBy(*by, "run_no").agg(
        F.max(F.when(F.col("version") == ORIGINAL, F.col(value))).alias(ORIGINAL),
        F.max(F.when(F.col("version") == PATCHED, F.col(value))).alias(PATCHED),
    )


def both_sides(pairs: DataFrame) -> DataFrame:
    """Pairs measured in both versions."""
    return pairs.where(F.col(ORIGINAL).isNotNull() & F.col(PATCHED).isNotNull())


def class_pairs_from_lines(lines: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """AG-02, FLT-13 and JN-02 in one shuffle: the last line per log, already paired."""
    times = without_warmup(test_times(lines), settings)

    def side(version: str) -> Column:
        position = F.when(F.col("version") == version, F.col("line_no"))
        return F.max_by("seconds", position).alias(version)

    return times.groupBy(*keys, "test_class", "run_no").agg(side(ORIGINAL), side(PATCHED))


def class_signs(pairs: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """FLT-14 / FLT-15 / AG-05: signs of every fully measured class above the noise floor."""
    return complete_above_noise(class_sides(pairs, settings, keys), settings)


def class_sides(pairs: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """Per class: runs on each side, least time, sums, and signs in both directions."""
    o, p = F.col(ORIGINAL), F.col(PATCHED)
    factor = 1.0 - settings.min_improvement
    return pairs.groupBy(*keys, "test_class").agg(
        F.count(o).alias("original_runs"),
        F.count(p).alias("patched_runs"),
        F.min(F.least(o, p)).alias("least_seconds"),
        F.sum(o).alias("original_seconds"),
        F.sum(p).alias("patched_seconds"),
        count_wins(o, p, factor).alias("wins"),
        count_losses(o, p, factor).alias("losses"),
        count_wins(p, o, factor).alias("reverse_wins"),
        count_losses(p, o, factor).alias("reverse_losses"),
    )


def complete_classes(sides: DataFrame, settings: TestSettings = DEFAULT) -> DataFrame:
    """FLT-14: measured in every run but the warm-up, in both versions."""
    n = settings.runs - 1
    return sides.where((F.col("original_runs") == n) & (F.col("patched_runs") == n))


def above_noise(sides: DataFrame, settings: TestSettings = DEFAULT) -> DataFrame:
    """FLT-15: no time below the noise floor on either side."""
    return sides.where(F.col("least_seconds") >= settings.noise_floor)


def complete_above_noise(sides: DataFrame, settings: TestSettings = DEFAULT) -> DataFrame:
    return above_noise(complete_classes(sides, settings), settings)


def with_p_values(signs: DataFrame) -> DataFrame:
    """AG-06 in both directions; all ties give null, which is never significant."""
    return signs.withColumn("p_value", sign_tail(F.col("wins"), F.col("losses"))).withColumn(
        "reverse_p_value", sign_tail(F.col("reverse_wins"), F.col("reverse_losses"))
    )


def significant(tested: DataFrame, settings: TestSettings = DEFAULT) -> DataFrame:
    """FLT-16."""
    return tested.where(F.col("p_value") < settings.max_p_value)


IMPROVED, REGRESSED = "patched_outperforms_original", "original_outperforms_patched"


def with_verdict(tested: DataFrame, settings: TestSettings = DEFAULT) -> DataFrame:
    """AG-07: the direction in which the class changed significantly, or null."""
    return tested.withColumn(
        "verdict",
        F.when(F.col("p_value") < settings.max_p_value, F.lit(IMPROVED)).when(
            F.col("reverse_p_value") < settings.max_p_value, F.lit(REGRESSED)
        ),
    )


def verdict_cells(verdicts: DataFrame, keys=COMMIT) -> DataFrame:
    """The dataset's map cell: direction to sorted class list, only significant classes."""

    def classes(direction: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("verdict") == direction, F.col("test_class"))))

    return verdicts.where(F.col("verdict").isNotNull()).groupBy(*keys).agg(
        F.create_map(F.lit(REGRESSED), classes(REGRESSED), F.lit(IMPROVED), classes(IMPROVED)).alias(
            "test_class_improvements"
        )
    )


def class_vectors(runs: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """AG-03: the times of a class in run order; at most one entry per run."""
    return without_warmup(runs, settings).groupBy(*keys, "test_class", "version").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("run_no", "seconds"))), lambda s: s["seconds"]
        ).alias("seconds")
    )


def total_improvement(totals: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """JN-01 / AG-04 / AG-06: improvement and p-value of whole runs per commit."""
    pairs = both_sides(paired(without_warmup(totals, settings), list(keys), "total_seconds"))
    return improvement_of_pairs(pairs, settings, keys)


def improvement_of_pairs(pairs: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """AG-04: improvement over all paired runs and its p-value."""
    factor = 1.0 - settings.min_improvement
    o, p = F.col(ORIGINAL), F.col(PATCHED)
    summed = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(o).alias("_o"),
        F.sum(p).alias("_p"),
        count_wins(o, p, factor).alias("wins"),
        count_losses(o, p, factor).alias("losses"),
    )
    return summed.select(
        *keys,
        "runs",
        relative_improvement(F.col("_o"), F.col("_p")).alias("exec_time_improvement"),
        sign_tail(F.col("wins"), F.col("losses")).alias("p_value"),
    )


# --- build outcome over log lines -------------------------------------------------


def log_outcomes(lines: DataFrame, keys=COMMIT) -> DataFrame:
    """FLT-10 and FLT-11 per log, from lines: ``build_ok`` and ``compile_error``.

    The multi-line form of a compile failure (goal, plugin and phase in this
    order anywhere in the log) is decided from the lines' positions, so a log
    is never glued together in one cell.
    """
    log = [*keys, "version", "run_no"]
    goal = r"(?i)Failed to execute goal "
    plugin = r"(?i)maven-compiler-plugin"
    phase = r"(?i):(compile|testCompile)\b"
    line, at = F.col("line"), F.col("line_no")
    # one test spares ordinary lines all the others
    suspect = line.rlike(r"(?i)compil|execute goal")

    def says(pattern: str) -> Column:
        return suspect & line.rlike(pattern)

    anchored = F.lit(False)
    continued = F.lit(False)
    for pattern in logtext.COMPILE_ERROR_LINES:
        anchored = anchored | line.rlike(pattern)
        continued = continued | line.rlike(pattern.replace(logtext.ERROR_MARK, r"^\s*"))
    flagged = lines.select(
        *log,
        at,
        F.contains(line, F.lit(logtext.SUCCESS_TEXT)).alias("success"),
        (F.contains(line, F.lit(logtext.FAILURE_TEXTS[0])) | F.contains(line, F.lit(logtext.FAILURE_TEXTS[1]))).alias("failure"),
        (suspect & anchored).alias("anchored"),
        (suspect & continued).alias("continued"),
        line.rlike(logtext.BARE_ERROR).alias("bare"),
        says(logtext.COMPILATION_FAILURE).alias("says_failure"),
        says(goal).alias("a"),
        says(plugin).alias("b"),
        says(phase).alias("c"),
        says(goal + ".*maven-compiler-plugin").alias("ab"),
        says(plugin + r".*:(compile|testCompile)\b").alias("bc"),
        says(logtext.GOAL_FAILED).alias("abc"),
    )
    per_log = flagged.groupBy(*log).agg(
        F.bool_or("success").alias("success"),
        F.bool_or("failure").alias("failure"),
        F.bool_or("anchored").alias("anchored"),
        (F.bool_or("continued") & F.bool_or("bare")).alias("parted"),
        F.bool_or("says_failure").alias("says_failure"),
        F.bool_or("abc").alias("abc"),
        F.min(F.when(F.col("a"), at)).alias("first_a"),
        F.min(F.when(F.col("ab"), at)).alias("first_ab"),
        F.max(F.when(F.col("c"), at)).alias("last_c"),
        F.max(F.when(F.col("bc"), at)).alias("last_bc"),
    )
    near = F.coalesce(
        F.col("abc") | (F.coalesce(F.col("first_ab") < F.col("last_c"), F.lit(False)))
        | (F.coalesce(F.col("first_a") < F.col("last_bc"), F.lit(False))),
        F.lit(False),
    )
    per_log = staged(per_log.withColumn("near", near), "log-marks")
    # plugin lines strictly between the first goal line and the last phase line
    open_logs = per_log.where(~F.col("near") & F.col("says_failure") & (F.col("first_a") < F.col("last_c")))
    between = (
        flagged.where("b").select(*log, F.col("line_no").alias("_b"))
        .join(open_logs.select(*log, "first_a", "last_c"), log)
        .where((F.col("_b") > F.col("first_a")) & (F.col("_b") < F.col("last_c")))
        .select(*log).distinct().withColumn("_between", F.lit(True))
    )
    goal_failed = F.col("near") | F.coalesce("_between", F.lit(False))
    # the mark alone on one line, its message on the next that is not blank
    parted = per_log.where("parted and not anchored").select(*log)
    full = lines.where(line.rlike(r"\S")).join(parted, log, "left_semi").select(*log, "line_no", "line")
    numbered = scan.running(full, log, "line_no", sums={"_k": F.lit(1)})
    marks = numbered.where(line.rlike(logtext.BARE_ERROR)).select(*log, (F.col("_k") + 1).alias("_k"))
    joined = (
        numbered.where(suspect & continued).select(*log, "_k").join(marks, [*log, "_k"]).select(*log).distinct().withColumn("_parted", F.lit(True))
    )
    return per_log.join(between, log, "left").join(joined, log, "left").select(
        *log,
        (F.col("success") & ~F.col("failure")).alias("build_ok"),
        (F.col("anchored") | F.coalesce("_parted", F.lit(False)) | (goal_failed & F.col("says_failure"))).alias("compile_error"),
    )


def logs_ok(lines: DataFrame, keys=COMMIT) -> DataFrame:
    """FLT-10 per log, from lines."""
    line = F.col("line")
    failure = F.contains(line, F.lit(logtext.FAILURE_TEXTS[0])) | F.contains(line, F.lit(logtext.FAILURE_TEXTS[1]))
    return lines.groupBy(*keys, "version", "run_no").agg(
        (F.bool_or(F.contains(line, F.lit(logtext.SUCCESS_TEXT))) & ~F.bool_or(failure)).alias("build_ok")
    )


def fully_successful(outcomes: DataFrame, keys=COMMIT) -> DataFrame:
    """FLT-12: commits all of whose logs, of both versions, succeeded."""
    return outcomes.groupBy(*keys).agg(F.bool_and("build_ok").alias("_ok")).where("_ok").drop("_ok")


def missing_logs(logs: DataFrame, settings: TestSettings = DEFAULT, keys=COMMIT) -> DataFrame:
    """SRC-03: the logs a complete measurement of each commit would need but lacks."""
    last = settings.first_run + settings.runs - 1
    present = logs.select(*keys, "version", "run_no").distinct()
    wanted = (
        logs.select(*keys).distinct()
        .withColumn("version", F.explode(F.array(F.lit(ORIGINAL), F.lit(PATCHED))))
        .withColumn("run_no", F.explode(F.sequence(F.lit(settings.first_run).cast("bigint"), F.lit(last).cast("bigint"))))
    )
    return wanted.join(present, [*keys, "version", "run_no"], "left_anti")


def total_times(lines: DataFrame, keys=COMMIT) -> DataFrame:
    """SC-07: the first total time of each log; an unknown form keeps null seconds."""
    return (
        lines.withColumn("_text", logtext.total_time_text(F.col("line")))
        .where(F.col("_text").isNotNull())
        .groupBy(*keys, "version", "run_no")
        .agg(F.min_by("_text", "line_no").alias("total_time"))
        .withColumn("seconds", logtext.total_time_seconds(F.col("total_time")))
    )

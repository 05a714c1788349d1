"""Dynamic measurement end to end: log lines to one verdict row per commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfmine.functions import links, logtext
from perfmine.functions.stats import count_losses, count_wins, relative_improvement, sign_tail
from perfmine.operators import measurement as m
from perfmine.operators.dataset import upsert
from perfmine.operators.evaluation import fold_outcomes
from perfmine.schemas import SUCCESS_STATUS
from perfmine.session import staged
from perfmine.sources.lines import read_log_set


def _class_runs(lines: DataFrame, settings: m.TestSettings, keys) -> DataFrame:
    """Per (commit, class, run) the last time on each side, which logs exist and how they ended.

    A line without a test has a null class; it still witnesses its log. All that is
    asked of a line is asked here, so the text is read and shuffled once.
    """
    text, version = F.col("line"), F.col("version")
    # one cheap test spares ordinary lines the pattern
    line = F.when(F.contains(text, F.lit("Tests run:")), text)
    parsed = lines.where(version.isin(m.ORIGINAL, m.PATCHED)).select(
        *keys,
        "run_no",
        "line_no",
        "version",
        logtext.test_class(line).alias("test_class"),
        logtext.test_seconds(line).alias("seconds"),
        F.contains(text, F.lit(logtext.SUCCESS_TEXT)).alias("success"),
        (F.contains(text, F.lit(logtext.FAILURE_TEXTS[0])) | F.contains(text, F.lit(logtext.FAILURE_TEXTS[1]))).alias("failure"),
    )

    def sides_of(side: str) -> list:
        own = version == side
        return [
            F.max_by("seconds", F.when(own, F.col("line_no"))).alias(side),
            F.bool_or(own).alias(f"has_{side}"),
            F.bool_or(own & F.col("success")).alias(f"success_{side}"),
            F.bool_or(own & F.col("failure")).alias(f"failure_{side}"),
        ]

    return parsed.groupBy(*keys, "test_class", "run_no").agg(*sides_of(m.ORIGINAL), *sides_of(m.PATCHED))


def measurable(lines: DataFrame, settings: m.TestSettings = m.DEFAULT, keys=m.COMMIT) -> DataFrame:
    """FLT-12 and SRC-03: commits with every log of both versions, all of which succeeded."""
    last = settings.first_run + settings.runs - 1
    wanted = F.col("build_ok") & F.col("run_no").between(settings.first_run, last) & F.col("version").isin(m.ORIGINAL, m.PATCHED)
    found = m.logs_ok(lines, keys).groupBy(*keys).agg(F.count_if(wanted).alias("_n"), F.bool_and("build_ok").alias("_ok"))
    return found.where((F.col("_n") == 2 * settings.runs) & F.col("_ok")).select(*keys)


def _commits(lines: DataFrame, settings: m.TestSettings, keys, *more) -> DataFrame:
    """One row per measurable commit, with the aggregates ``more`` over its rows of classes.

    Rows of a class have ``improved`` or ``regressed`` true if it changed
    significantly. Grouping sets derive class rows and run rows from one table of
    paired times; the run rows also tell whether the commit has all its logs and
    all succeeded (FLT-12, SRC-03).
    """
    runs = _class_runs(lines, settings, keys).withColumn("measured", F.col("run_no") > settings.first_run)
    o, p = (F.when(F.col("measured"), F.col(side)) for side in (m.ORIGINAL, m.PATCHED))
    both = o.isNotNull() & p.isNotNull()
    factor = 1.0 - settings.min_improvement
    last = settings.first_run + settings.runs - 1
    by_class = [*keys, "test_class"]
    by_run = [*keys, "run_no"]

    def ended_well(side: str):
        return F.bool_or(f"success_{side}") & ~F.bool_or(f"failure_{side}")

    sides = runs.groupingSets([by_class, by_run], *keys, "test_class", "run_no").agg(
        F.grouping("run_no").alias("is_class"),
        F.count(F.when(both, F.lit(1))).alias("pairs"),
        F.min(F.least(F.when(both, o), F.when(both, p))).alias("least_seconds"),
        count_wins(o, p, factor).alias("wins"),
        count_losses(o, p, factor).alias("losses"),
        count_wins(p, o, factor).alias("reverse_wins"),
        count_losses(p, o, factor).alias("reverse_losses"),
        F.coalesce(F.sum(o), F.lit(0.0)).alias("o"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("p"),
        (F.bool_or("has_original").cast("int") + F.bool_or("has_patched").cast("int")).alias("logs"),
        (ended_well(m.ORIGINAL).cast("int") + ended_well(m.PATCHED).cast("int")).alias("good_logs"),
    )
    enough = F.col("pairs") == settings.runs - 1
    of_run = F.col("is_class") == 0
    tested = ~of_run & F.col("test_class").isNotNull() & enough & (F.col("least_seconds") >= settings.noise_floor)
    better = F.when(tested, sign_tail(F.col("wins"), F.col("losses")))
    worse = F.when(tested, sign_tail(F.col("reverse_wins"), F.col("reverse_losses")))
    improved = F.coalesce(F.col("better") < settings.max_p_value, F.lit(False))
    regressed = ~improved & F.coalesce(F.col("worse") < settings.max_p_value, F.lit(False))
    is_run = of_run & (F.col("logs") == 2) & (F.col("run_no") > settings.first_run)
    rows = (
        sides.withColumn("better", better)
        .withColumn("worse", worse)
        .withColumn("improved", improved)
        .withColumn("regressed", regressed)
        .withColumn("is_run", is_run)
    )
    run_o, run_p = F.when(F.col("is_run"), F.col("o")), F.when(F.col("is_run"), F.col("p"))
    wanted = of_run & F.col("run_no").between(settings.first_run, last)
    found = rows.groupBy(*keys).agg(
        F.count_if("is_run").alias("runs"),
        F.sum(run_o).alias("_o"),
        F.sum(run_p).alias("_p"),
        count_wins(run_o, run_p, factor).alias("_wins"),
        count_losses(run_o, run_p, factor).alias("_losses"),
        F.sum(F.when(wanted, F.col("good_logs"))).alias("_good"),
        F.bool_or(of_run & (F.col("good_logs") < F.col("logs"))).alias("_failed"),
        *more,
    )
    names = [c for c in found.columns if c not in keys and c != "runs" and not c.startswith("_")]
    return found.where((F.col("runs") > 0) & (F.col("_good") == 2 * settings.runs) & ~F.col("_failed")).select(
        *keys,
        "runs",
        relative_improvement(F.col("_o"), F.col("_p")).alias("exec_time_improvement"),
        sign_tail(F.col("_wins"), F.col("_losses")).alias("p_value"),
        *names,
    )


def measured_commits(lines: DataFrame, settings: m.TestSettings = m.DEFAULT, keys=m.COMMIT) -> DataFrame:
    """One row per measurable commit: total improvement, p-value, numbers of classes faster and slower."""
    return _commits(
        lines, settings, keys, F.count_if("improved").alias("improved_classes"), F.count_if("regressed").alias("regressed_classes")
    )


def dataset_updates(lines: DataFrame, settings: m.TestSettings = m.DEFAULT) -> DataFrame:
    """Rows for the dataset: improvement, p-value, class map and status of every measurable commit.

    ``commit_id`` is a path key ``owner__repo_sha``; commits with another form are
    left out. A commit that lacks a log or has a failed one gives no row. The map
    has one cell per commit, as large as its number of significant classes.
    """

    def classes(flag: str):
        return F.array_sort(F.collect_list(F.when(F.col(flag), F.col("test_class"))))

    cell = F.create_map(F.lit(m.REGRESSED), classes("regressed"), F.lit(m.IMPROVED), classes("improved")).alias("test_class_improvements")
    commit = links.decode_path_key(F.col("commit_id"))
    return (
        _commits(lines, settings, m.COMMIT, cell)
        .select(
            commit["repo"].alias("repo"),
            commit["sha"].alias("after_commit"),
            F.lit(SUCCESS_STATUS).alias("exec_status"),
            "exec_time_improvement",
            "p_value",
            "test_class_improvements",
        )
        .where("repo is not null and after_commit is not null")
    )


def record_measurements(spark: SparkSession, path, dataset: DataFrame, commit: Column, settings: m.TestSettings = m.DEFAULT) -> DataFrame:
    """The dataset after the logs at ``path`` have been taken in.

    ``commit`` gives the path key of a log from the column ``file``, its path. The
    text is read once; rows of commits that are not measurable stay as they are.
    """
    return upsert(dataset, dataset_updates(read_log_set(spark, path, commit), settings))


def evaluation_results(candidates: DataFrame, lines: DataFrame, settings: m.TestSettings, must_pass: str | None = m.ORIGINAL) -> DataFrame:
    """AG-22, AG-03, AG-07: the six result fields of each candidate, and ``setup_error``.

    Times and class verdicts are those of candidates that succeeded, else null. The
    times are the totals of all runs in order, the first one too; the class map
    has both directions, with the classes that changed significantly.
    """
    folded = fold_outcomes(candidates, m.log_outcomes(lines), must_pass, settings)
    passed = folded.where("test_success").select("commit_id")
    times = staged(m.last_time_per_class(m.test_times(lines)).join(passed, "commit_id", "left_semi"), "class-times")
    last = settings.first_run + settings.runs - 1
    spine = passed.withColumn("run_no", F.explode(F.sequence(F.lit(settings.first_run).cast("bigint"), F.lit(last).cast("bigint"))))
    totals = times.groupBy("commit_id", "run_no").agg(
        *[F.sum(F.when(F.col("version") == v, F.col("seconds"))).alias(v) for v in (m.ORIGINAL, m.PATCHED)]
    )

    def in_order(v: str):
        rows = F.array_sort(F.collect_list(F.struct("run_no", F.coalesce(F.col(v), F.lit(0.0)).alias("t"))))
        return F.transform(rows, lambda r: r["t"]).alias(f"{v}_exec_times")

    vectors = spine.join(totals, ["commit_id", "run_no"], "left").groupBy("commit_id").agg(in_order(m.ORIGINAL), in_order(m.PATCHED))
    pairs = m.both_sides(m.paired(m.without_warmup(times, settings), ["commit_id", "test_class"]))
    cells = m.verdict_cells(m.with_verdict(m.with_p_values(m.class_signs(pairs, settings)), settings))
    none = F.expr(f"map('{m.REGRESSED}', cast(array() as array<string>), '{m.IMPROVED}', cast(array() as array<string>))")
    cell = F.when(F.col("test_success"), F.coalesce("test_class_improvements", none))
    return folded.join(vectors, "commit_id", "left").join(cells, "commit_id", "left").select(
        "commit_id", "patch_applicable", "compile_success", "test_success", cell.alias("significant_improvements"),
        "original_exec_times", "patched_exec_times", "setup_error",
    )


def commit_improvement(lines: DataFrame, settings: m.TestSettings = m.DEFAULT, keys=m.COMMIT) -> DataFrame:
    """Total improvement and its p-value per measurable commit, from raw log lines."""
    runs = _class_runs(lines, settings, keys)
    totals = runs.groupBy(*keys, "run_no").agg(
        F.coalesce(F.sum(m.ORIGINAL), F.lit(0.0)).alias(m.ORIGINAL),
        F.coalesce(F.sum(m.PATCHED), F.lit(0.0)).alias(m.PATCHED),
        (F.bool_or("has_original") & F.bool_or("has_patched")).alias("both_logs"),
    )
    pairs = totals.where(F.col("both_logs") & (F.col("run_no") > settings.first_run)).join(measurable(lines, settings, keys), list(keys), "left_semi")
    return m.improvement_of_pairs(pairs, settings, keys)

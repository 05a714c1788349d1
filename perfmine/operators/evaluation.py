"""Outcome of candidate patches and tests, and how well they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.operators.measurement import ORIGINAL, PATCHED, TestSettings

#: An evaluation runs each version twice.
EVALUATION = TestSettings(runs=2)

# The judgements, best first.
JUDGEMENTS = ("Exact Match", "Semantic Equivalence", "Partial Improvement", "Correct Location", "Off", "N/A")
SEMANTIC = ("Exact Match", "Semantic Equivalence")
LOCATION = (*SEMANTIC, "Correct Location")
NOT_GENERATED = "N/A"
SLICES = ("all", "generated", "single_file", "multi_file", "single_module", "multi_module")


def fold_outcomes(
    candidates: DataFrame, outcomes: DataFrame, must_pass: str | None = ORIGINAL, settings: TestSettings = EVALUATION
) -> DataFrame:
    """AG-22: one result per candidate from the outcomes of its logs.

    A patch that does not apply fails everything; else the first failing log in
    run order decides (the original version runs first), and later logs may be
    absent, as the runs stop there. A failure of the version ``must_pass`` is an
    error of the setup. So is a candidate without a failing log that lacks a log
    of either version; its test fields are null.
    """
    failed = F.col("compile_error") | ~F.col("build_ok")
    order = F.struct("run_no", F.when(F.col("version") == ORIGINAL, 0).otherwise(1))
    last = settings.first_run + settings.runs - 1
    expected = F.col("version").isin(ORIGINAL, PATCHED) & F.col("run_no").between(settings.first_run, last)
    first = outcomes.groupBy("commit_id").agg(
        F.count_if(expected).alias("_logs"),
        F.min_by(F.struct("version", "compile_error"), F.when(failed, order)).alias("_first"),
    )
    stopped = F.col("_first").isNotNull()
    complete = F.coalesce(F.col("_logs") == 2 * settings.runs, F.lit(False))
    ran = F.col("patch_applicable") & (stopped | complete)
    lacking = F.col("patch_applicable") & ~stopped & ~complete
    broken = F.lit(False) if must_pass is None else F.col("patch_applicable") & F.coalesce(F.col("_first.version") == must_pass, F.lit(False))
    return candidates.join(first, "commit_id", "left").select(
        "commit_id",
        "patch_applicable",
        F.when(~F.col("patch_applicable"), F.lit(False)).when(ran, ~F.coalesce(F.col("_first.compile_error"), F.lit(False))).alias("compile_success"),
        F.when(~F.col("patch_applicable"), F.lit(False)).when(ran, ~stopped).alias("test_success"),
        (broken | lacking).alias("setup_error"),
    )


def with_dataset(judged: DataFrame, dataset: DataFrame) -> DataFrame:
    """JN-12: judged patches with their dataset row, by commit, else by pull request.

    Both keys go with the repository: a pull request's number means nothing
    without it. One dataset row answers per key, of a pull request with several
    commits that of the smallest sha, so no judged patch is repeated.
    ``n_files`` and ``n_modules`` are null for a patch without a match. Rows
    without a sha do not enter the first join.
    """
    found = F.struct("n_files", "n_modules")
    by_sha = dataset.where(F.col("after_commit").isNotNull()).groupBy("repo", F.col("after_commit").alias("sha")).agg(F.min(found).alias("_row"))
    by_pull = dataset.where(F.col("pr_number").isNotNull()).groupBy("repo", "pr_number").agg(
        F.min_by(found, F.struct("after_commit", "n_files", "n_modules")).alias("_row")
    )
    with_sha = judged.where(F.col("sha").isNotNull()).join(by_sha, ["repo", "sha"], "left")
    without = judged.where(F.col("sha").isNull()).unionByName(with_sha.where(F.col("_row").isNull()).drop("_row"))
    rows = with_sha.where(F.col("_row").isNotNull()).unionByName(without.join(by_pull, ["repo", "pr_number"], "left"))
    return rows.select(
        "id", "judgment", "pass_tests", F.col("_row.n_files").alias("n_files"), F.col("_row.n_modules").alias("n_modules"),
        F.col("_row").isNotNull().alias("matched"),
    )


def judgement_tally(judged: DataFrame) -> DataFrame:
    """AG-14: patches per judgement, also those with none, and the total as ``ALL``."""
    spark = judged.sparkSession
    spine = spark.createDataFrame([(j,) for j in JUDGEMENTS], "judgment string")
    counts = judged.groupBy("judgment").agg(F.count(F.lit(1)).alias("_n"))
    dense = spine.join(counts, "judgment", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return dense.rollup("judgment").agg(F.sum("_n").alias("n"), F.grouping("judgment").alias("_total")).select(
        F.when(F.col("_total") == 1, F.lit("ALL")).otherwise(F.col("judgment")).alias("judgment"), "n"
    )


def slice_table(judged: DataFrame) -> DataFrame:
    """AG-15: counts and shares over six overlapping slices; an empty slice has none."""
    generated = F.col("judgment") != NOT_GENERATED
    member = {
        "all": F.lit(True),
        "generated": generated,
        "single_file": F.col("n_files") == 1,
        "multi_file": F.col("n_files") > 1,
        "single_module": F.col("n_modules") == 1,
        "multi_module": F.col("n_modules") > 1,
    }
    names = F.array_compact(F.array(*[F.when(member[s], F.lit(s)) for s in SLICES]))
    counts = judged.withColumn("slice", F.explode(names)).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(generated).alias("generated"),
        F.count_if(F.col("judgment").isin(*LOCATION)).alias("location"),
        F.count_if(F.col("judgment").isin(*SEMANTIC)).alias("semantic"),
        F.count_if("pass_tests").alias("passing"),
    )

    def share(name: str) -> Column:
        return F.round(F.try_divide(F.col(name) * 100.0, F.col("n")), 1).alias(f"{name}_pct")

    measured = ("generated", "location", "semantic", "passing")
    return counts.select("slice", "n", *measured, *[share(c) for c in measured])


def detector_quality(labels: DataFrame) -> DataFrame:
    """AG-16: confusion counts, precision and recall; a ratio over nothing is null."""
    d, t = F.col("detected"), F.col("truth")
    counts = labels.agg(
        F.count_if(d & t).alias("tp"), F.count_if(d & ~t).alias("fp"),
        F.count_if(~d & t).alias("fn"), F.count_if(~d & ~t).alias("tn"),
    )
    return counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.try_divide("tp", F.col("tp") + F.col("fn"))
    )


def confirmed_share(sample: DataFrame, confirmed: Column) -> DataFrame:
    """AG-17: confirmed rows, all rows and their ratio."""
    return sample.agg(F.count_if(confirmed).alias("confirmed"), F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.try_divide("confirmed", "n")
    )


def flag_share(flags: DataFrame) -> DataFrame:
    """AG-18: repositories with a flag set, over distinct (repository, flag) rows."""
    return flags.select("repo", "flag").distinct().agg(
        F.count_if("flag").alias("flagged"), F.count(F.lit(1)).alias("repos")
    )

"""Counts, dense pivots, buckets and summaries over the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfmine.functions import links
from perfmine.functions.stats import exact_quantiles
from perfmine.functions.text import stripped
from perfmine.schemas import SUCCESS_STATUS

# Report bounds and star buckets, closed on the left, open on the right.
MIN_REPO_ITEMS = 10
YEARS = (2015, 2025)
STAR_BINS = (20, 50, 100, 250, 500, 1_000, 5_000, 20_000, 100_000)
STAR_LABELS = ("20-49", "50-99", "100-249", "250-499", "500-999", "1k-4.9k", "5k-19.9k", "20k-99.9k")
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def is_success() -> Column:
    return F.coalesce(F.col("exec_status") == SUCCESS_STATUS, F.lit(False))


def repo_summary(dataset: DataFrame) -> DataFrame:
    """AG-08: rows and successful rows per repository; a null repository is a group."""
    return dataset.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(is_success()).alias("successful")
    )


def major_repos(summary: DataFrame, least: int = MIN_REPO_ITEMS) -> DataFrame:
    """FLT-19 / SC-04 / ST-01: repositories with enough rows, most first, with their label."""
    kept = summary.where(F.col("total_items") >= least)
    return kept.withColumn("label", links.short_label(F.col("repo"))).orderBy(F.col("total_items").desc(), "repo")


def grand_totals(summary: DataFrame) -> DataFrame:
    """AG-26: totals over the repositories that passed the filter."""
    return summary.agg(
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum("successful"), F.lit(0)).alias("successful"),
    )


def repo_counts(dataset: DataFrame) -> DataFrame:
    """AG-09: distinct repositories, of all rows and of successful rows.

    One row per repository first, so no distinct set is built in one task.
    """
    per_repo = dataset.where(F.col("repo").isNotNull()).groupBy("repo").agg(F.bool_or(is_success()).alias("ok"))
    return per_repo.agg(F.count(F.lit(1)).alias("repos"), F.count_if("ok").alias("successful_repos"))


def _dense_counts(rows: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """AG-10 / AG-11: counts by success for every row of the spine, zero if empty."""
    counts = rows.groupBy(key).agg(
        F.count_if(~F.col("ok")).alias("not_successful"), F.count_if("ok").alias("successful")
    )
    return spine.join(counts, key, "left").fillna(0, ["not_successful", "successful"])


def by_year(dataset: DataFrame, years=YEARS) -> DataFrame:
    """FLT-18 / AG-10 / AG-11: rows per commit year and success."""
    rows = dataset.where(F.col("commit_year").between(*years)).select("commit_year", is_success().alias("ok"))
    spine = dataset.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("commit_year"))
    return _dense_counts(rows, spine, "commit_year")


def star_bucket(stars: Column) -> Column:
    """SC-25: the label of the bucket, null outside all."""
    bucket = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(STAR_BINS, STAR_BINS[1:], STAR_LABELS))):
        bucket = F.when((stars >= low) & (stars < high), F.lit(label)).otherwise(bucket)
    return bucket


def in_star_range(dataset: DataFrame) -> DataFrame:
    """FLT-18: stars known and within the buckets."""
    return dataset.where(F.col("repo_stars").between(STAR_BINS[0], STAR_BINS[-1] - 1))


def by_stars(dataset: DataFrame) -> DataFrame:
    """FLT-18 / SC-25 / AG-10 / AG-11: rows per star bucket and success."""
    rows = in_star_range(dataset).select(star_bucket(F.col("repo_stars")).alias("star_bucket"), is_success().alias("ok"))
    spine = dataset.sparkSession.createDataFrame([(s,) for s in STAR_LABELS], "star_bucket string")
    return _dense_counts(rows, spine, "star_bucket")


def with_years_and_stars(dataset: DataFrame, years: DataFrame, stars: DataFrame) -> DataFrame:
    """JN-11: year by ``repo@sha`` and stars by repository; unknown stays null."""
    keyed = dataset.withColumn("_key", links.commit_key(F.col("repo"), F.col("after_commit"))).withColumn(
        "_repo", stripped(F.col("repo"))
    )
    by_key = years.select(F.col("commit_key").alias("_key"), "commit_year")
    by_repo = stars.select(F.col("repo").alias("_repo"), F.col("stars").alias("repo_stars"))
    return keyed.join(by_key, "_key", "left").join(by_repo, "_repo", "left").drop("_key", "_repo")


def five_numbers(rows: DataFrame, value: str, groups=()) -> DataFrame:
    """AG-12: minimum, quartiles (linear) and maximum; no row for no data."""
    if groups:
        return exact_quantiles(rows, list(groups), value, QUARTILES)
    return exact_quantiles(rows.withColumn("_all", F.lit(1)), ["_all"], value, QUARTILES).drop("_all")


def length_stats(dataset: DataFrame, lengths: dict[str, Column]) -> DataFrame:
    """AG-13: minimum, maximum and median of list lengths, for all and for successful rows.

    Lengths are whole numbers, so they are counted first; the median then works
    on (length, count) pairs, of which there are few.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("list"), c.cast("bigint").alias("length")) for n, c in lengths.items()])
    populations = F.when(is_success(), F.array(F.lit("all"), F.lit("successful"))).otherwise(F.array(F.lit("all")))
    rows = dataset.select(F.explode(pairs).alias("_p"), populations.alias("_g")).select("_p.*", "_g")
    counted = (
        rows.where(F.col("length").isNotNull())
        .withColumn("population", F.explode("_g"))
        .groupBy("population", "list", "length")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy("population", "list").agg(
        F.min("length").alias("min"), F.max("length").alias("max"),
        F.percentile("length", F.lit(0.5), F.col("_n")).alias("median"),
    )


def registry_images(images: DataFrame, prefix: str = "ghcr") -> DataFrame:
    """FLT-26 / SET-05: images of one registry, each id once."""
    return images.where(F.col("repository").startswith(prefix)).select("image_id", "size_bytes").dropDuplicates(["image_id"])


def with_mib(images: DataFrame) -> DataFrame:
    """SC-18."""
    return images.withColumn("mib", F.col("size_bytes") / F.lit(1048576.0))

"""Statistics: sign test, relative improvement, exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfmine.session import cut_lineage


def sign_tail(wins: Column, losses: Column) -> Column:
    """P(X >= wins) for X ~ Binomial(wins + losses, 1/2); null without any sign.

    The terms are added in log space from the far end, so that thousands of
    signs neither overflow nor vanish.
    """
    n = wins + losses
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lc"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(
            (acc["lc"] + F.log((n - i) / (i + F.lit(1.0)))).alias("lc"),
            (acc["s"] + F.exp(acc["lc"])).alias("s"),
        )

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), losses), start, step, lambda acc: acc["s"])
    return F.when(n > 0, F.least(tail, F.lit(1.0)))


def relative_improvement(original: Column, patched: Column) -> Column:
    """(original - patched) / original; null where original is zero."""
    return F.try_divide(original - patched, original)


def count_wins(reference: Column, candidate: Column, factor: float) -> Column:
    """Pairs in which ``candidate`` beats ``factor * reference``."""
    return F.count_if(_comparable(reference, candidate) & (candidate < F.lit(factor) * reference))


def count_losses(reference: Column, candidate: Column, factor: float) -> Column:
    """Pairs in which ``candidate`` misses ``factor * reference``; ties count in neither."""
    return F.count_if(_comparable(reference, candidate) & (candidate > F.lit(factor) * reference))


def _comparable(a: Column, b: Column) -> Column:
    # Spark orders NaN above every number; a NaN pair has no sign
    return ~F.isnan(a) & ~F.isnan(b)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per group, plus ``n``, ``min`` and ``max``.

    Values are first reduced to (value, count), then range-partitioned, so that
    neither copies nor one big group meet in one task. Only the partitions that
    hold a wanted rank are ranked row by row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    # the range bounds are sampled, so the layout is fixed before it is used twice
    ranged = cut_lineage(
        counted.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id())
    )
    parts = ranged.groupBy(*groups, "_part").agg(
        F.sum("_n").alias("_pn"), F.min(value).alias("_pmin"), F.max(value).alias("_pmax")
    )
    upto = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    parts = parts.select(
        *groups,
        "_part",
        (F.sum("_pn").over(upto) - F.col("_pn")).alias("_before"),
        F.col("_pn"),
        F.sum("_pn").over(whole).alias("n"),
        F.min("_pmin").over(whole).alias("min"),
        F.max("_pmax").over(whole).alias("max"),
    )
    # zero-based ranks on both sides of each quantile
    wanted = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.array(F.floor((F.col("n") - 1) * F.lit(p)), F.ceil((F.col("n") - 1) * F.lit(p)))
                    for p in probs.values()
                ]
            )
        )
    )
    picks = parts.select("*", F.explode(wanted).alias("_rank")).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_pn"))
    )
    inside = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    needed = picks.select(*groups, "_part", "_before").distinct()
    ranked = ranged.join(needed, [*groups, "_part"]).select(
        *groups, "_part", value, "_n", (F.col("_before") + F.sum("_n").over(inside)).alias("_end")
    )
    hits = ranked.join(picks.select(*groups, "_part", "_rank"), [*groups, "_part"]).where(
        (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n"))
    ).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"))
    summary = parts.groupBy(*groups).agg(F.max("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))

    def quantile(p: float) -> Column:
        h = (F.col("n") - 1) * F.lit(p)
        low = F.element_at("_at", F.floor(h)).cast("double")
        high = F.element_at("_at", F.ceil(h)).cast("double")
        return low + (high - low) * (h - F.floor(h))

    return summary.join(hits, groups).select(
        *groups, "n", "min", *[quantile(p).alias(name) for name, p in probs.items()], "max"
    )

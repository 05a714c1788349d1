"""Samples of system pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.functions import logtext

THRESHOLD = 10.0
REPORT_EVERY = 12


def samples(lines: DataFrame) -> DataFrame:
    """SC-16: the ``some`` lines with their averages as a map."""
    return lines.where(F.ltrim("line").startswith("some")).withColumn("pressure", logtext.pressure_values(F.col("line")))


def exceeded(parsed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """FLT-22: one row per average above the threshold."""
    return parsed.select("seq", "file", F.explode("pressure").alias("metric", "value")).where(F.col("value") > threshold)


def with_largest(parsed: DataFrame) -> DataFrame:
    """AG-30: the largest average of a sample."""
    return parsed.withColumn("largest", F.array_max(F.map_values("pressure")))


def every_nth(parsed: DataFrame, n: int = REPORT_EVERY) -> DataFrame:
    """W-06: every n-th sample of the sequence."""
    return parsed.where(F.col("seq") % n == 0)

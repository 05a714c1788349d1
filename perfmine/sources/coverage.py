"""Testwise coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfmine import schemas


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: JSON lines with ``commit_id``, ``version``, ``module`` and ``tests``; the keys may also be folders."""
    from pyspark.sql import types as T

    keyed = T.StructType(
        [
            *schemas.COVERAGE_REPORT.fields,
            T.StructField("commit_id", T.LongType()),
            T.StructField("version", T.StringType()),
            T.StructField("module", T.StringType()),
        ]
    )
    return spark.read.schema(keyed).json(path)


def read_report_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One pretty-printed report per file; ``pattern`` takes version and module from its path."""
    file = F.col("_metadata.file_path")
    return spark.read.schema(schemas.COVERAGE_REPORT).option("multiLine", "true").json(path).select(
        F.regexp_extract(file, pattern, 1).alias("version"), F.regexp_extract(file, pattern, 2).alias("module"), "tests"
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, all keys among the columns."""
    reports.write.json(path)

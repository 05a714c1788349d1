"""Result files: evaluation JSON and found commits as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perfmine import schemas

# an empty message is a value, so null has a mark of its own
_FOUND_CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N"}


def write_evaluations(results: DataFrame, path: str) -> None:
    """SNK-03: one JSON object per candidate."""
    results.write.mode("errorifexists").json(path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import types as T

    keyed = T.StructType([T.StructField("commit_id", T.LongType()), *schemas.EVALUATION.fields])
    return spark.read.schema(keyed).json(path)


def write_found_commits(found: DataFrame, path: str) -> None:
    """SNK-04: distinct rows under a header."""
    found.distinct().write.mode("errorifexists").options(**_FOUND_CSV).csv(path)


def read_found_commits(spark: SparkSession, path: str) -> DataFrame:
    schema = "owner string, repo string, commit_hash string, url string, message string"
    return spark.read.schema(schema).options(**_FOUND_CSV).csv(path)

"""Small label files: judgements, samples, flag lists, class lists, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine import schemas
from perfmine.functions.text import stripped

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _by_position(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The first columns under our own names; further columns are dropped."""
    raw = spark.read.options(**_CSV).csv(path)
    return raw.toDF(*[f"_{i}" for i in range(len(raw.columns))]).select(
        [F.col(f"_{i}").alias(name) for i, name in enumerate(names)]
    )


def read_patch_judgements(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: judged patches, with or without the legend columns to the right."""
    return _by_position(spark, path, schemas.PATCH_JUDGEMENT_COLUMNS).where(F.col("issue").isNotNull())


def read_precision_sample(spark: SparkSession, path: str) -> DataFrame:
    return _by_position(spark, path, schemas.PRECISION_COLUMNS)


def read_accuracy_sample(spark: SparkSession, path: str) -> DataFrame:
    rows = _by_position(spark, path, schemas.ACCURACY_COLUMNS)
    return rows.withColumn("is_detected", F.lower("is_detected") == "true").withColumn(
        "is_confirmed", F.lower("is_confirmed") == "yes"
    )


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: distinct ``owner/name True|False`` lines; comments, blanks and other lines are skipped."""
    form = r"^\s*([\w.-]+/[\w.-]+)\s+(True|False)\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(form))
    return lines.select(
        F.regexp_extract("value", form, 1).alias("repo"), (F.regexp_extract("value", form, 2) == "True").alias("flag")
    ).distinct()


def read_commit_codes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: ``url[,code]`` lines; the code may be missing."""
    return spark.read.schema("url string, code string").csv(path).where(F.col("url").isNotNull())


def read_test_lists(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: one test class per line, keyed by the name of its directory."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return spark.read.text(path).select(folder.alias("key"), stripped(F.col("value")).alias("test_class")).where(
        F.col("test_class") != ""
    )


def read_year_star_cache(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC-17: the cache of commit years and stars as two tables.

    With one object per line, lines are read as text and parsed in place. The JSON
    source parses bytes, and for each text with a new name in it copies a table of up
    to 6000 names so far; in a cache nearly every line has a name of its own.
    """
    if multi_line:
        cache = spark.read.schema(schemas.YEAR_STAR_CACHE).option("multiLine", "true").json(path)
    else:
        # a line may also hold a list of objects; an outer row keeps the parser out of a filter of its own
        objects = F.from_json("value", T.ArrayType(schemas.YEAR_STAR_CACHE))
        cache = spark.read.text(path).select(F.inline_outer(objects))
    years = cache.select(F.explode("commit_year_by_repo_sha").alias("commit_key", "commit_year"))
    stars = cache.select(F.explode("repo_stars").alias("repo", "stars"))
    return years, stars


def read_build_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """SRC-16: configuration files below ``<path>/<repo>/`` as (repo_id, path, content)."""
    rows = spark.read.text([f"{path}/*/{n}" for n in names], wholetext=True)
    form = r"/([^/]+)/((?:\.mvn/)?[^/]+)$"
    file = F.col("_metadata.file_path")
    return rows.select(
        F.regexp_extract(file, form, 1).alias("repo_id"), F.regexp_extract(file, form, 2).alias("path"),
        F.col("value").alias("content"),
    )


def parse_image_lines(lines: DataFrame) -> DataFrame:
    """SRC-14: ``repository<TAB>id`` lines; lines of another shape are skipped."""
    parts = F.split("line", "\t", 2)
    return lines.where(F.instr("line", "\t") > 0).withColumn("repository", F.get(parts, F.lit(0))).withColumn(
        "image_id", F.get(parts, F.lit(1)).try_cast("bigint")
    ).drop("line")

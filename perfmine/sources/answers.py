"""The cache of model answers: one JSON invocation per file, ``{hash}-{version}.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine import schemas
from perfmine.functions import scan
from perfmine.session import staged

#: Digits of the hash that name a folder of the table cache.
DIGITS = 2

_NAME = r"^([0-9a-f]{32})-(\d+)\.json$"


def read_answer_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: invocations with the hash and version of their file name."""
    rows = spark.read.schema(schemas.INVOCATION).option("multiLine", "true").json(path)
    name = F.col("_metadata.file_name")
    return rows.select(
        F.regexp_extract(name, _NAME, 1).alias("prompt_hash"),
        F.regexp_extract(name, _NAME, 2).try_cast("bigint").alias("version"),
        "prompt",
        "response",
        "invocation_time",
    ).where(F.col("prompt_hash") != "")


def first_answers(cache: DataFrame) -> DataFrame:
    """SRC-09 / ST-05: per prompt the first file, of it the first sample."""
    return cache.groupBy("prompt_hash").agg(F.min_by("response", "version").alias("_r")).select(
        "prompt_hash", F.get("_r.samples", F.lit(0))["content"].alias("response")
    )


def new_entries(cache: DataFrame, fresh: DataFrame, read_from_cache: bool = True) -> DataFrame:
    """SNK-05: what to append to the cache, with its version suffix.

    With reading on, a cached prompt is not stored again and of equal prompts in
    ``fresh`` the one with the smallest ``seq`` is kept. With reading off, all
    are kept and numbered on from the versions that exist. ``seq`` is an integer,
    unique per row.
    """
    if read_from_cache:
        missing = fresh.join(cache.select("prompt_hash").distinct(), "prompt_hash", "left_anti")
        columns = [c for c in missing.columns if c not in ("prompt_hash", "seq")]
        kept = missing.groupBy("prompt_hash").agg(F.min_by(F.struct("seq", *columns), "seq").alias("_r"))
        return kept.select("prompt_hash", F.lit(0).cast("bigint").alias("version"), "_r.*")
    counts = cache.groupBy("prompt_hash").agg(F.count(F.lit(1)).alias("_cached"))
    # the caller's numbers may lie far apart
    chunks = scan.row_chunks(fresh, ["prompt_hash"], "seq")
    numbered = scan.running(chunks, ["prompt_hash"], "seq", sums={"_nth": F.lit(1).cast("bigint")})
    return numbered.join(counts, "prompt_hash", "left").withColumn(
        "version", F.coalesce("_cached", F.lit(0).cast("bigint")) + F.col("_nth") - 1
    ).drop("_cached", "_nth")


def append_entries(entries: DataFrame, path: str, digits: int = DIGITS) -> None:
    """Append to a table cache, laid out by the first digits of the hash.

    The rebalance hint gives few files per folder and splits a large one.
    """
    laid_out = entries.withColumn("prefix", F.substring("prompt_hash", 1, digits)).hint("rebalance", F.col("prefix"))
    laid_out.write.mode("append").partitionBy("prefix").option("compression", "zstd").parquet(path)


def stored_answers(path: str, asked: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The entries of a table cache for the questions ``asked``, by ``prompt_hash``.

    Only folders of hashes that are asked for are read. The driver sees their names,
    of which there are at most 16 ** ``digits``. A cache that does not exist is empty.
    """
    spark = asked.sparkSession
    cache = T.StructType([*schemas.ANSWER.fields, T.StructField("prefix", T.StringType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schemas.ANSWER)
    hashes = asked.select("prompt_hash").where(F.col("prompt_hash").isNotNull()).distinct()
    prefixes = [r[0] for r in hashes.select(F.substring("prompt_hash", 1, digits)).distinct().collect()]
    rows = spark.read.schema(cache).parquet(path).where(F.col("prefix").isin(prefixes))
    return rows.join(hashes, "prompt_hash", "left_semi").select(*schemas.ANSWER.names)


def record_answers(fresh: DataFrame, path: str, digits: int = DIGITS) -> None:
    """SNK-05: append the answers whose question the table cache does not hold yet.

    ``fresh`` has ``prompt_hash``, ``seq`` and any other columns of an entry; what is
    absent is stored as null. A repeated call appends nothing. Rows without a hash are
    left out.
    """
    fresh = staged(fresh.where(F.col("prompt_hash").isNotNull()), "answers")
    entries = new_entries(stored_answers(path, fresh, digits), fresh)
    columns = [
        (F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ANSWER
    ]
    append_entries(entries.select(*columns), path, digits)

"""Text files as numbered lines, splittable files included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfmine.session import staged


def read_lines(spark: SparkSession, path, log: Column | None = None) -> DataFrame:
    """SRC-05 / SRC-08: rows of (log, line_no, line), numbered from 1 per log.

    ``log`` is derived from the column ``file``, the path; all files of a log
    are numbered on in path order. By default every file is a log of its own.
    A file is read in blocks by many tasks. Row ids rise by one along a block, so
    a line's number is its id's distance from the block's first id plus the lines
    of all earlier blocks. Only the table of blocks is shuffled; it is written
    first, so that its true size decides whether the join sends it to all tasks.
    """
    return _numbered(spark, path, {"log": F.col("file") if log is None else log})


def _numbered(spark: SparkSession, path, of_file: dict[str, Column]) -> DataFrame:
    """Lines numbered per ``log``, with what ``of_file`` derives from the path.

    That is asked of each block, not of each line. Lines without a log are left out.
    """
    # the reader keeps the order of a block, which this id follows
    rows = text_rows(spark.read.text(path)).drop("log").withColumn("_at", F.monotonically_increasing_id())
    block = ["file", "_block"]
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    named = sizes.select(*block, "_n", "_first", *[value.alias(name) for name, value in of_file.items()])
    earlier = Window.partitionBy("log").orderBy(part_number(), "file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    blocks = staged(named.select(*block, *of_file, (before + 1 - F.col("_first")).alias("_shift")), "line-blocks")
    # asked of the written table: before it, the filter would go down to the lines
    return rows.join(blocks.where(F.col("log").isNotNull()), block).select(*of_file, (F.col("_at") + F.col("_shift")).alias("line_no"), "line")


def text_rows(texts: DataFrame, log: Column | None = None) -> DataFrame:
    """(file, _block, line, log) of a text source, batch or stream."""
    rows = texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"),
    )
    return rows.withColumn("log", F.col("file") if log is None else log)


def part_number() -> Column:
    """The number in ``part-<n>…``, null for other names; as text it has no fixed width."""
    return F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")


def write_lines(lines: DataFrame, path: str, log: str, position: str) -> None:
    """Logs as text, one folder per log; a large log becomes several files in order."""
    ordered = lines.repartitionByRange(log, position).sortWithinPartitions(log, position)
    ordered.select(F.col(log).alias("log"), F.col("line").alias("value")).write.partitionBy("log").text(path)


def folder_of(name: str = "log") -> Column:
    """The log of a file below ``name=…/``."""
    return F.regexp_extract("file", rf"/{name}=([^/]*)/", 1)


# The two names of a run's log, with the version and the run's number.
LOG_NAMES = (r"([A-Za-z_]+?)_repo_mvnw_(\d+)\.log", r"mvnw_(\d+)_([A-Za-z_]+)\.log")


def read_log_set(spark: SparkSession, path, commit: Column) -> DataFrame:
    """SRC-03: the logs of measured commits as (commit_id, version, run_no, line_no, line).

    ``<version>_repo_mvnw_<n>.log`` counts runs from 1, ``mvnw_<n>_<version>.log``
    from 0; both give ``run_no`` from 1. ``new_patched``, the patched version of a
    patch evaluation, is ``patched``. ``commit`` is derived from the column
    ``file``, the path. Other files are left out. ``missing_logs`` tells what a
    commit lacks.
    """
    file = F.col("file")
    first, second = LOG_NAMES
    named, counted = F.nullif(F.regexp_extract(file, first, 1), F.lit("")), F.nullif(F.regexp_extract(file, second, 2), F.lit(""))
    version = F.coalesce(counted, named)
    run_no = F.when(counted.isNotNull(), F.regexp_extract(file, second, 1).try_cast("bigint") + 1).otherwise(
        F.regexp_extract(file, first, 2).try_cast("bigint")
    )
    of_file = {
        "log": F.when(version.isNotNull(), file),
        "commit_id": commit,
        "version": F.when(version == "new_patched", F.lit("patched")).otherwise(version),
        "run_no": run_no,
    }
    return _numbered(spark, path, of_file).select("commit_id", "version", "run_no", "line_no", "line")

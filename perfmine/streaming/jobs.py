"""Structured Streaming forms of the incremental jobs.

All of them take a streaming DataFrame, so the source is the caller's choice,
and process what is there when ``available_now`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from perfmine import schemas
from perfmine.operators import applog, mining, pressure
from perfmine.sources.keyed import KeyedStore
from perfmine.sources.lines import part_number

#: A batch reads the buckets its shas fall in, so there are more than a batch has shas.
SEEN_BUCKETS = 1024


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def results_store(spark: SparkSession, path: str) -> KeyedStore:
    """The dataset as a store that :func:`upsert_results` writes deltas to."""
    return KeyedStore(spark, path, schemas.DATASET, schemas.DATASET_KEY)


def upsert_results(
    results: DataFrame, path: str, checkpoint: str, order: str = "seq", stream: str = "results", available_now: bool = True
) -> StreamingQuery:
    """STR-01: add finished analyses to the stored dataset, one delta per batch.

    A batch writes its own rows only; the merge happens when the store is read or
    compacted. ``order`` decides within a batch and between batches, so a late row
    changes nothing but what is null. A batch that is replayed after a failure is
    passed over: ``stream`` names the progress that belongs to ``checkpoint``.
    ``save_dataset(results_store(...).read(), ...)`` publishes the CSV form.
    """
    store = results_store(results.sparkSession, path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, order, stream, batch_id)
        store.compact()
        store.expire()

    return _start(results.writeStream.foreachBatch(merge), checkpoint, available_now)


def unseen_commits(
    commits: DataFrame, known: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """STR-02: commits that neither came before nor are in the dataset, below ``path``.

    Resuming must not repeat work. Each batch is reduced to one row per sha, which
    combines copies before the shuffle, and leaves out the shas of a keyed store,
    ``path/_seen``. Of that a batch reads the latest few deltas and the buckets its
    shas fall in, not what all earlier batches wrote. The rows go to ``batch=n``
    before their shas go to the store: a batch that fails in between is repeated
    whole, one that is replayed later is passed over.
    """
    rows = commits.schema
    spark = commits.sparkSession
    seen = KeyedStore(spark, f"{path}/_seen", T.StructType([rows["sha"]]), ["sha"], SEEN_BUCKETS)
    spark.createDataFrame([], rows).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        before = seen.latest()
        if batch_id <= before.batches.get("commits", -1):
            return
        fresh = mining.unseen(batch, known).join(seen.lookup(batch, before), "sha", "left_anti")
        fresh.select(*rows.names).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        written = spark.read.schema(rows).parquet(f"{path}/batch={batch_id}")
        seen.write(written.select("sha", F.lit(batch_id).alias("seq")), "seq", "commits", batch_id, before)
        seen.compact()
        seen.expire()

    return _start(commits.writeStream.foreachBatch(keep), checkpoint, available_now)


#: Lines known of a file; the row without a file is that of the whole log, with its last file.
_NUMBERED = T.StructType(
    [
        T.StructField("log", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("last", T.StringType()),
    ]
)


def number_lines(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    part: Column | None = None,
    stream: str = "lines",
    available_now: bool = True,
) -> StreamingQuery:
    """STR-04 / SRC-05: (log, line_no, line) of logs that grow, below ``path``.

    ``lines`` is ``text_rows`` of a streaming text source. A log grows by further
    files, in the order of ``part`` (by default the number in ``part-<n>``) and name;
    lines are numbered on from 1 as one read of all of them would. A keyed store
    remembers how many lines each file and log had, and a batch looks up its own
    logs only. A file that comes again gives only the lines behind those it had, so a
    replay gives none, and the last file of a log may be longer than before. Lines
    for a place before a later file that is numbered already raise ``ValueError``.
    Rows without a log are left out. ``stream`` names the progress that belongs to
    ``checkpoint``.
    """
    spark = lines.sparkSession
    seen = KeyedStore(spark, f"{path}/_seen", _NUMBERED, ["log", "file"], SEEN_BUCKETS)
    spark.createDataFrame([], "log string, line_no bigint, line string").write.mode("overwrite").parquet(f"{path}/stream=none/batch=-1")

    def table(name: str, batch_id: int, rows: DataFrame) -> DataFrame:
        folder = f"{path}/_{name}/{stream}/{batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        return spark.read.schema(rows.schema).parquet(folder)

    def keep(batch: DataFrame, batch_id: int) -> None:
        before = seen.latest()
        if batch_id <= before.batches.get(stream, -1):
            return
        rows = batch.where(F.col("log").isNotNull()).withColumn("_at", F.monotonically_increasing_id())
        in_block = ["log", "file", "_block"]
        blocks = table("blocks", batch_id, rows.groupBy(*in_block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))
        files = blocks.groupBy("log", "file").agg(F.sum("_n").alias("n")).withColumn("part", part_number() if part is None else part)
        logs = files.select("log", F.lit("").alias("file")).distinct()
        known = table("known", batch_id, seen.lookup(files.select("log", "file").unionByName(logs), before))
        had = known.where("file <> ''").select("log", "file", F.col("n").alias("had"))
        whole = known.where("file = ''").select("log", F.col("n").alias("total"), F.struct("part", F.col("last").alias("file")).alias("end"))
        earlier = Window.partitionBy("log").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("bigint")
        placed = (
            files.join(had, ["log", "file"], "left").join(whole, "log", "left")
            .withColumns({"had": F.coalesce("had", zero), "total": F.coalesce("total", zero)})
            .withColumn("new", F.greatest(zero, F.col("n") - F.col("had")))
            .withColumn("start", F.col("total") + F.coalesce(F.sum("new").over(earlier), zero) - F.col("had"))
        )
        placed = table("files", batch_id, placed)
        late = placed.where("new > 0").where(F.struct("part", "file") < F.col("end")).select("file").first()
        if late:
            raise ValueError(f"{late[0]} has lines before a file that is numbered already")
        above = Window.partitionBy("log", "file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        shifts = (
            blocks.withColumn("_shift", F.coalesce(F.sum("_n").over(above), zero) + 1 - F.col("_first"))
            .join(placed.where("new > 0").select("log", "file", "start", "had"), ["log", "file"])
            .select(*in_block, "_shift", "start", "had")
        )
        at = F.col("_at") + F.col("_shift")
        numbered = rows.join(shifts, in_block).where(at > F.col("had")).select("log", (F.col("start") + at).alias("line_no"), "line")
        numbered.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch_id}")
        grown = placed.where("new > 0")
        ends = grown.groupBy("log").agg((F.max("total") + F.sum("new")).alias("n"), F.max(F.struct("part", "file")).alias("end"))
        state = grown.select("log", "file", "n", "part", F.lit(None).cast("string").alias("last")).unionByName(
            ends.select("log", F.lit("").alias("file"), "n", F.col("end.part").alias("part"), F.col("end.file").alias("last"))
        )
        seen.write(state.withColumn("seq", F.lit(before.number)), "seq", stream, batch_id, before)
        seen.compact()
        seen.expire()

    return _start(lines.writeStream.foreachBatch(keep), checkpoint, available_now)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`number_lines` has written so far."""
    return spark.read.schema("log string, line_no bigint, line string, stream string, batch bigint").parquet(path).select("log", "line_no", "line")


def pressure_alerts(
    lines: DataFrame, alerts_path: str, reports_path: str, checkpoint: str, available_now: bool = True
) -> tuple[StreamingQuery, StreamingQuery]:
    """STR-03: readings above the threshold, and the largest average of every twelfth sample."""
    parsed = pressure.samples(lines)
    alerts = pressure.exceeded(parsed)
    reports = pressure.with_largest(pressure.every_nth(parsed)).select("seq", "file", "largest")
    return (
        _start(alerts.writeStream.format("parquet").option("path", alerts_path), f"{checkpoint}/alerts", available_now),
        _start(reports.writeStream.format("parquet").option("path", reports_path), f"{checkpoint}/reports", available_now),
    )


def commit_times(lines: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """STR-04: first and result time per commit from growing logs.

    Update mode without a watermark: the state holds one row per commit.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(
        applog.commit_times(lines).writeStream.outputMode("update").foreachBatch(keep), checkpoint, available_now
    )


def latest_commit_times(spark: SparkSession, path: str) -> DataFrame:
    """The newest state per commit of :func:`commit_times`."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("commit").agg(F.max_by(F.struct("start", "end"), "batch").alias("_s")).select("commit", "_s.*")

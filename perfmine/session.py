"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows on its way to Python; Spark's own bounds are 10 000 rows and 64 MB.
BATCH_BYTES = 2 << 20


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "perfmine") -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) a local folder is made.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="perfmine-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/perfmine/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of about ``BATCH_BYTES``, one row at least.

    The JVM and each worker hold a batch several times over, and keep most of that
    memory for the next one. With whole texts in them, batches of 10 000 rows add
    up to hundreds of megabytes in an executor.
    """
    spark.conf.set(BATCH_KEY, BATCH_BYTES)


def cut_lineage(df):
    """Materialise ``df`` reliably, so that later stages do not recompute it."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def staged(df, name: str):
    """Write ``df`` as a table in the shared folder and read it back.

    For an input that is used several times: it is computed once, and the
    planner then knows its true size when it chooses join strategies. What is
    a staged table already is not written again. Keys are often digests, which
    zstd halves.
    """
    if vars(df).get("_is_staged"):
        return df
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._is_staged = True
    return table

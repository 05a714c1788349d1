"""Small file-system steps: the pointer to the current version of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"
#: Stands for whatever version is published.
ANY = "*"


def new_version(path: str) -> str:
    return f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Point ``path`` at ``version``. The pointer is replaced by one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = path.rstrip("/")
    temporary = jvm.org.apache.hadoop.fs.Path(f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    fs = target.getFileSystem(conf)
    out = fs.create(temporary, True)
    out.write(bytearray(version.rsplit("/", 1)[-1].encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, options)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version, or None."""
    root = path.rstrip("/")
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return f"{root}/{spark.read.text(str(pointer.toString())).first()[0]}"


def replace(df: DataFrame, path: str, write, base: str | None = ANY) -> str:
    """Write ``df`` to a new version with ``write(df, folder)``, then publish it.

    Fails if the published version is no longer ``base``, None meaning that there
    was none. The check precedes the rename by a moment, so writers that finish
    at the same time still need a lock of their own.
    """
    version = new_version(path)
    write(df, version)
    if base != ANY and current(df.sparkSession, path) != base:
        raise RuntimeError(f"{path} was replaced by another writer; {version} is not published")
    publish(df.sparkSession, path, version)
    return version

"""A keyed table that is merged when it is read.

A write adds a folder with its own rows and nothing else. Every stored value carries
where it stands in the order, so folders merge in any grouping to the same rows: per
key and column the last value that is not null. Folders of one level are merged into
one of the next when ``FANOUT`` have come together, so a row is rewritten once per
level, and the levels grow with the logarithm of the table.

``versions/<number>.json`` lists the folders of a version. A writer creates the file
that follows the version it read. The file is written beside and renamed without
overwriting, so of two writers one fails, before any row of its own can be seen.
That is atomic where the file system's rename is (it is on HDFS).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many folders of one level become one of the next.
FANOUT = 8
#: Versions that :meth:`KeyedStore.expire` leaves.
KEPT = 10

_BUCKET = "_bucket"
_PLACE = T.StructType([T.StructField("order", T.LongType()), T.StructField("version", T.LongType())])


class LostRace(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: Folders, each with its level.
    parts: tuple[tuple[str, int], ...] = ()
    #: The last batch of every stream that writes here.
    batches: dict[str, int] = field(default_factory=dict)


def _place(column: str) -> str:
    return f"_at_{column}"


class KeyedStore:
    """Rows of ``schema`` below ``path``, one per value of ``keys``.

    ``buckets`` is fixed for the life of a store. Merged folders are laid out by a hash
    of the keys, so that :meth:`lookup` leaves most of them unread.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.columns = [f.name for f in schema if f.name not in self.keys]
        places = [T.StructField(_place(c), _PLACE) for c in self.columns]
        self._stored = T.StructType([*[schema[k] for k in self.keys], *[schema[c] for c in self.columns], *places])
        self._placed = T.StructType([*self._stored.fields, T.StructField(_BUCKET, T.IntegerType())])

    # -- versions --

    def latest(self) -> Version:
        """The newest version; number 0 and no folder where nothing was written."""
        numbers = self._numbers()
        return self._version(max(numbers)) if numbers else Version()

    def write(self, rows: DataFrame, order: str, stream: str = "", batch: int | None = None, base: Version | None = None) -> Version:
        """Add ``rows`` to ``base``, by default the newest version.

        ``order`` is an integer and decides between values of a key, whichever write
        they come with: a late row with a smaller one loses. Equal ones go to the later
        write; within a write ``order`` is unique per key. Rows with a null key or order
        are left out, as are columns that the store does not have. A ``batch`` that
        ``stream`` has already written is passed over, so a replay changes nothing.
        Raises :class:`LostRace` if ``base`` is no longer the newest.
        """
        base = base or self.latest()
        if batch is not None and batch <= base.batches.get(stream, -1):
            return base
        number = base.number + 1
        place = F.struct(F.col(order).cast("bigint").alias("order"), F.lit(number).cast("bigint").alias("version"))
        valid = F.col(order).isNotNull()
        for key in self.keys:
            valid = valid & F.col(key).isNotNull()
        values = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in self.schema}
        placed = rows.where(valid).select(
            *[values[f.name].cast(f.dataType).alias(f.name) for f in self.schema],
            *[F.when(values[c].isNotNull(), place).alias(_place(c)) for c in self.columns],
        )
        folder = self._folder(number)
        self._merged(placed).write.parquet(folder)
        batches = base.batches if batch is None else {**base.batches, stream: batch}
        return self._publish(Version(number, (*base.parts, (folder, 0)), batches))

    def compact(self, fanout: int = FANOUT) -> Version:
        """Merge the folders of every level that has ``fanout`` of them."""
        version, level = self.latest(), 0
        while any(at >= level for _, at in version.parts):
            here = [p for p in version.parts if p[1] == level]
            if len(here) >= fanout:
                number = version.number + 1
                folder = self._folder(number)
                rows = self._merged(self._rows(here)).withColumn(_BUCKET, self._bucket())
                rows.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(folder)
                parts = tuple(p for p in version.parts if p[1] != level)
                version = self._publish(Version(number, (*parts, (folder, level + 1)), version.batches))
            level += 1
        return version

    def expire(self, keep: int = KEPT) -> None:
        """Delete all versions but the last ``keep``, and the folders that only they use.

        Whoever still reads an older version fails. A folder of a write that is under
        way stays, as its number is that of a version to come.
        """
        numbers = sorted(self._numbers())
        old, kept = numbers[:-keep], numbers[-keep:]
        if not old:
            return
        used = {folder.rsplit("/", 1)[-1] for n in kept for folder, _ in self._version(n).parts}
        for number in old:
            self._delete(self._file(number))
        for name in self._list("data"):
            if int(name.split("-")[0]) <= kept[0] and name not in used:
                self._delete(f"{self.path}/data/{name}")

    # -- rows --

    def read(self, version: Version | None = None) -> DataFrame:
        """All rows of a version, by default the newest."""
        return self._rows_of((version or self.latest()).parts).select(*self.schema.names)

    def lookup(self, wanted: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows whose keys are in ``wanted``, from the buckets that these fall in.

        The driver sees the numbers of buckets, of which there are at most ``buckets``.
        """
        version = version or self.latest()
        wanted = wanted.select(*self.keys).distinct()
        numbers = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        rows = self._rows(version.parts, numbers).join(wanted, self.keys, "left_semi")
        return self._merged(rows).select(*self.schema.names)

    def _rows_of(self, parts) -> DataFrame:
        rows = self._rows(parts)
        return rows if len(parts) == 1 else self._merged(rows)

    def _rows(self, parts, numbers: list[int] | None = None) -> DataFrame:
        """Stored rows of the folders, with ``numbers`` only of these buckets where there are buckets."""
        plain = [folder for folder, level in parts if level == 0]
        found = [self.spark.read.schema(self._stored).parquet(*plain)] if plain else []
        for folder in (folder for folder, level in parts if level > 0):
            laid_out = self.spark.read.schema(self._placed).parquet(folder)
            if numbers is not None:
                laid_out = laid_out.where(F.col(_BUCKET).isin(numbers))
            found.append(laid_out.drop(_BUCKET))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self._stored)

    def _merged(self, rows: DataFrame) -> DataFrame:
        if not self.columns:
            return rows.distinct()
        return rows.groupBy(*self.keys).agg(
            *[F.max_by(c, _place(c)).alias(c) for c in self.columns],
            *[F.max(_place(c)).alias(_place(c)) for c in self.columns],
        )

    def _bucket(self) -> Column:
        typed = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int")

    # -- files --

    def _folder(self, number: int) -> str:
        return f"{self.path}/data/{number:020d}-{uuid.uuid4().hex}"

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        path, fs = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._list("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def _delete(self, name: str) -> None:
        path, fs = self._hadoop(name)
        fs.delete(path, True)

    def _version(self, number: int) -> Version:
        text = self.spark.read.text(self._file(number), wholetext=True).first()[0]
        found = json.loads(text)
        return Version(number, tuple((f"{self.path}/data/{name}", level) for name, level in found["parts"]), found["batches"])

    def _publish(self, version: Version) -> Version:
        if max(self._numbers(), default=0) >= version.number:
            raise LostRace(f"{self.path} has version {version.number} already")
        parts = [(folder.rsplit("/", 1)[-1], level) for folder, level in version.parts]
        jvm = self.spark._jvm
        target, fs = self._hadoop(self._file(version.number))
        beside, _ = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps({"parts": parts, "batches": version.batches}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, target, plain)
        except Py4JJavaError as error:
            fs.delete(beside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise LostRace(f"{self.path} has version {version.number} already") from error
            raise
        return version

"""The commit dataset: CSV with JSON cells, replaced as a whole and atomically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfmine import schemas
from perfmine.functions import cells
from perfmine.sources import store

_NESTED = [f.name for f in schemas.DATASET if not isinstance(f.dataType, (T.StringType, T.LongType, T.DoubleType))]
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def empty_dataset(spark: SparkSession) -> DataFrame:
    """SNK-06: no rows, full schema."""
    return spark.createDataFrame([], schemas.DATASET)


def decode(raw: DataFrame, python_literals: bool = True) -> DataFrame:
    """All-string rows to the typed dataset."""

    def typed(field: T.StructField):
        column = F.col(field.name)
        if field.name in _NESTED:
            return cells.decode_cell(column, field.dataType, python_literals).alias(field.name)
        if isinstance(field.dataType, T.LongType):
            return cells.whole_number(column).alias(field.name)
        return column.try_cast(field.dataType).alias(field.name)

    return raw.select([typed(f) for f in schemas.DATASET])


def encode(dataset: DataFrame) -> DataFrame:
    """SNK-02: nested cells as JSON text; null stays null."""
    return dataset.select(
        [
            F.to_json(F.col(f.name)).alias(f.name) if f.name in _NESTED else F.col(f.name)
            for f in schemas.DATASET
        ]
    )


def read_dataset_csv(spark: SparkSession, path: str, python_literals: bool = True) -> DataFrame:
    """SRC-01: one CSV file, or a folder of files with one header. Columns go by name.

    A column that is absent is an error; others than the dataset's are left out.
    """
    raw = spark.read.options(**_CSV, enforceSchema="false").csv(path)
    absent = [f.name for f in schemas.DATASET if f.name not in raw.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    return decode(raw, python_literals)


def _read_own_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_dataset_csv`` wrote: all columns in order, cells in JSON."""
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.DATASET])
    return decode(spark.read.schema(strings).options(**_CSV).csv(path), python_literals=False)


def write_dataset_csv(dataset: DataFrame, path: str) -> None:
    options = {k: v for k, v in _CSV.items() if k != "multiLine"}
    encode(dataset).write.mode("errorifexists").options(**options).csv(path)


def load_dataset(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The published version, or the one given; an empty dataset where none exists."""
    version = version or store.current(spark, path)
    return empty_dataset(spark) if version is None else _read_own_csv(spark, version)


def save_dataset(dataset: DataFrame, path: str, base: str | None = store.ANY) -> str:
    """SNK-02: write a new version beside the old one, then move the pointer.

    ``base`` is the version that ``dataset`` was made from. If another writer has
    published since, nothing is replaced and an error is raised.
    """
    return store.replace(dataset, path, write_dataset_csv, base)

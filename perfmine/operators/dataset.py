"""Keyed upsert and lookups on the commit dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfmine.schemas import DATASET_KEY, STATUSES, SUCCESS_STATUS
from perfmine.session import staged


def newest_values(updates: DataFrame, order: str, keys=DATASET_KEY) -> DataFrame:
    """One row per key: of every column the last value that is not null."""
    columns = [c for c in updates.columns if c not in keys and c != order]
    return updates.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def upsert(old: DataFrame, new: DataFrame, keys=DATASET_KEY) -> DataFrame:
    """SNK-01 / JN-10: null-preserving merge; ``new`` has one row per key.

    A value that is not null replaces the old one, in all duplicates of the key;
    an absent key is appended. Two joins on the keys replace the full outer
    join: a small ``new`` is then broadcast by Spark's own size check, and the
    old rows are not shuffled. Rows with a null key are no records and are left
    out of ``new``, which is staged, as it is used three times.
    """
    keys = list(keys)
    valid = F.lit(True)
    for key in keys:
        valid = valid & F.col(key).isNotNull()
    new = staged(new.where(valid), "updates")
    columns = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns if c in new.columns])

    def merged(c: str) -> Column:
        return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)

    updated = old.join(fresh, keys, "left").select(*keys, *[merged(c) for c in columns])
    matched = old.select(*keys).join(new.select(*keys), keys, "left_semi").distinct()
    added = new.join(matched, keys, "left_anti")
    return updated.unionByName(added, allowMissingColumns=True).select(*old.columns)


def with_status(dataset: DataFrame, status: str = SUCCESS_STATUS) -> DataFrame:
    """FLT-17."""
    return dataset.where(F.col("exec_status") == status)


def lookup(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """SRC-15: an inline table. It is part of the program, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, names))


def status_ranks(spark: SparkSession) -> DataFrame:
    return lookup(spark, [(name, rank) for rank, name in enumerate(STATUSES)], ["exec_status", "rank"])


def list_length(column: str) -> Column:
    """SC-24: length of a list; null for no list."""
    return F.when(F.col(column).isNotNull(), F.size(column))


def with_empty_list(dataset: DataFrame, column: str) -> DataFrame:
    """FLT-23: rows whose list has no element."""
    return dataset.where(list_length(column) == 0)

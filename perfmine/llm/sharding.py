"""Shard placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table. The
shards take turns; in its turn a shard claims the first free slot of its
permutation. Adding or removing a shard moves little more than its own share.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MOST_SLOTS = 2_000_003
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None) -> np.ndarray:
    """The shard number of every slot.

    ``size`` must be prime and larger than the number of shards; a shard of
    weight w claims w slots in its turn. Names must be distinct. The same
    names give the same table, in whatever order they are listed.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be one or more distinct names")
    if not is_prime(size) or not len(shards) < size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime above the number of shards and at most {MOST_SLOTS}")
    weights = weights or (1,) * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 per shard")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "little") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "little") % (size - 1) + 1 for d in digests]
    table = [-1] * size
    free = size
    while free:
        for shard in order:
            for _ in range(weights[shard]):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % size
                table[at[shard]] = shard
                free -= 1
                if not free:
                    return np.array(table, dtype=np.int32)
    return np.array(table, dtype=np.int32)


def _with_shard(df: DataFrame, keys: list[str], shards: tuple[str, ...], size: int, weights: tuple[int, ...] | None) -> DataFrame:
    owners = lookup_table(shards, size, weights)
    slots = df.sparkSession.createDataFrame(
        [(i, int(s), shards[s]) for i, s in enumerate(owners)], "slot int, shard int, shard_name string"
    )
    slot = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(size)).cast("int")
    return df.withColumn("slot", slot).join(F.broadcast(slots), "slot")


def place(df: DataFrame, keys: list[str], shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None) -> DataFrame:
    """``keys`` with (slot, shard, shard_name), one row per row of ``df``.

    Rows of equal keys get the same shard, null keys and repeated rows included.
    The broadcast table has ``size`` rows, at most ``MOST_SLOTS``, whatever the
    input. Where one key holds a large share of the rows, name a further column
    in ``keys``, such as a row id, to spread it. Columns other than the keys are
    dropped first, so their names cannot clash. Texts are hashed whole.
    """
    return _with_shard(df.select(*keys), keys, shards, size, weights).select(*keys, "slot", "shard", "shard_name")


def write_shards(df: DataFrame, keys: list[str], path: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None, salts: int = 8) -> None:
    """Write the rows of ``df`` into one folder per shard, ``shard_name=...``.

    A shard's rows are dealt over ``salts`` tasks, so that a shard larger than
    one executor's memory is written by several. Columns of ``df`` named slot,
    shard or shard_name are refused.
    """
    if {"slot", "shard", "shard_name"} & {c.lower() for c in df.columns}:
        raise ValueError("slot, shard and shard_name are names of this operator")
    placed = _with_shard(df, keys, shards, size, weights).drop("slot", "shard")
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    placed.repartition(F.col("shard_name"), salt).write.partitionBy("shard_name").parquet(path)

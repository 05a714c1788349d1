"""Running values over ordered rows, without putting a whole group in one task.

A plain window needs all rows of its partition in one task, so one huge log
file or patch would decide the run time of the job. Here the position is cut
into chunks. Rows meet only the rows of their own chunk; what earlier chunks
contribute comes from a table with one row per chunk. Rows are shuffled on
(keys, chunk), which splits a hot key evenly.

Chunks of fixed width need no look at the data and suit positions that count
lines. Where positions have gaps, a chunk may hold a single row and that table
be as long as the input; :func:`row_chunks` cuts by rows instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfmine.session import staged

CHUNK = 1_000_000


def row_chunks(df: DataFrame, keys: list[str], position: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``_chunk``, chunks of about equally many rows whatever their positions.

    Rows are range-partitioned by (keys, position) and written with the number of
    their partition, so every reader sees the same chunks. A key has at most as many
    chunks as there are partitions: ``parts`` if given, else as many as the size asks for.
    """
    order = [*keys, position]
    ranged = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    return staged(ranged.withColumn("_chunk", F.spark_partition_id().cast("bigint")), "row-chunks")


def cut(df: DataFrame, keys: list[str], position: str, chunk: int | None) -> DataFrame:
    """``df``, written once for several readers, in chunks of ``chunk`` positions; null cuts by rows.

    Partitioning by range looks for its bounds first: what it reads is written too, or it would be worked out twice.
    """
    if chunk is None:
        return row_chunks(staged(df, "rows"), keys, position)
    return staged(df.withColumn("_chunk", _fixed(position, chunk)), "chunks")


def _fixed(position: str, chunk: int) -> Column:
    return F.floor(F.col(position) / F.lit(chunk))


def running(
    df: DataFrame,
    keys: list[str],
    position: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    anchors: dict[str, tuple[Column, str]] | None = None,
    chunk: int = CHUNK,
    keep_chunk: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running sums, last non-null values and minima per key.

    They include the current row unless ``exclusive`` is set.
    ``position`` is an integer, unique within a key. ``sums`` count nulls as 0.
    An anchor ``(value, sum)`` is the last ``value - sum`` of the rows that have a
    value: the base from which a counter with that running sum goes on.
    A ``_chunk`` column of the input takes the place of ``chunk``: that of
    :func:`row_chunks`, or the one ``keep_chunk`` leaves for a second scan over the
    same keys, which then reuses the first scan's shuffle.
    """
    sums, lasts, mins, anchors = sums or {}, lasts or {}, mins or {}, anchors or {}
    columns = [c for c in df.columns if c != "_chunk"]
    base = df if "_chunk" in df.columns else df.withColumn("_chunk", _fixed(position, chunk))
    for name, expr in {**sums, **lasts, **mins}.items():
        base = base.withColumn(f"_x_{name}", expr)

    for name, (value, _) in anchors.items():
        base = base.withColumn(f"_x_{name}", value)

    group = [*keys, "_chunk"]
    here = Window.partitionBy(*group).orderBy(position).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    local = base.select(
        *columns,
        "_chunk",
        *[F.col(f"_x_{n}") for n in [*sums, *lasts, *mins, *anchors]],
        *[F.sum(F.coalesce(F.col(f"_x_{n}"), F.lit(0))).over(here).alias(f"_l_{n}") for n in sums],
        *[F.last(f"_x_{n}", ignorenulls=True).over(here).alias(f"_l_{n}") for n in lasts],
        *[F.min(f"_x_{n}").over(here).alias(f"_l_{n}") for n in mins],
    )
    for name, (_, counter) in anchors.items():
        local = local.withColumn(f"_x_{name}", F.col(f"_x_{name}") - F.col(f"_l_{counter}"))
        local = local.withColumn(f"_l_{name}", F.last(f"_x_{name}", ignorenulls=True).over(here))

    # plain totals combine before the shuffle; anchors need the chunk's own running sums
    totals = (local if anchors else base).groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.coalesce(F.col(f"_x_{n}"), F.lit(0))).alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(F.col(f"_x_{n}"), F.when(F.col(f"_x_{n}").isNotNull(), F.col(position))).alias(f"_t_{n}")
            for n in [*lasts, *anchors]
        ],
        *[F.min(f"_x_{n}").alias(f"_t_{n}") for n in mins],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "*",
        F.count(F.lit(1)).over(before).alias("_seen"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins],
    )
    for name, (_, counter) in anchors.items():
        absolute = F.col(f"_t_{name}") - F.col(f"_c_{counter}")
        carried = carried.withColumn(f"_c_{name}", F.last(absolute, ignorenulls=True).over(before))
    # most keys lie in one chunk and need nothing carried
    carry = carried.where(F.col("_seen") > 0).select(
        *group, *[f"_c_{n}" for n in [*sums, *lasts, *mins, *anchors]]
    )

    def shifted(name: str, counter: str) -> Column:
        return F.col(f"_l_{name}") - F.coalesce(F.col(f"_c_{counter}"), F.lit(0))

    return local.join(carry, group, "left").select(
        *columns,
        *(["_chunk"] if keep_chunk else []),
        *[(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in lasts],
        *[F.least(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in mins],
        *[F.coalesce(shifted(n, counter), F.col(f"_c_{n}")).alias(n) for n, (_, counter) in anchors.items()],
    )

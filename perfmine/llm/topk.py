"""Exact top-k search by inner product as a Voronoi join.

Queries are grouped by the nearest of a few pivots. For a group with pivot c and
radius r, every query q and every vector x satisfy

    c.x - r|x|  <=  q.x  <=  c.x + r|x|

The (k+1)-th largest left side over all vectors is thus a score that each query
of the group reaches k times beside itself. A vector is sent to a group only if
its right side reaches that score. Groups are solved in blocks of queries and
vectors, and the blocks' best answers are ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfmine.llm.common import arrow_map

#: Rows of a block, its parts being solved in one task.
BLOCK_QUERIES, BLOCK_VECTORS = 1024, 4096
LEAST_PIVOTS, MOST_PIVOTS = 8, 256
#: Queries from which the pivots are made, at most.
SAMPLE = 2048
_SLACK = 1e-9


def finite_vector(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null unless all are finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(embedding.isNotNull() & fine, scaled)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; a vector shorter than ``width`` ends in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass(frozen=True)
class Groups:
    """Pivots of the query groups with what is known of each group."""

    pivots: np.ndarray
    radius: np.ndarray | None = None
    blocks: np.ndarray | None = None
    reached: np.ndarray | None = None  # a score that each query of the group reaches k times

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and distance of each vector."""
        apart = np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)
        group = apart.argmin(axis=1)
        return group, apart[np.arange(len(vectors)), group]

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of each vector with any query of each group."""
        middle = vectors @ self.pivots.T
        norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        spread = np.outer(norm, self.radius) + _SLACK * np.outer(norm, np.abs(self.pivots).sum(axis=1) + self.radius)
        return middle - spread, middle + spread


def make_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of ``n`` cells of the sample, by a few rounds of means."""
    pivots = sample[np.linspace(0, len(sample) - 1, num=min(n, len(sample)), dtype=int)].astype(float)
    for _ in range(4):
        group, _ = Groups(pivots).nearest(sample)
        pivots = np.stack([sample[group == g].mean(axis=0) if (group == g).any() else p for g, p in enumerate(pivots)])
    return pivots


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer scores; beyond 64 bits they stay at the end of the range."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), dtype=np.int64)
    most = float(np.abs(queries.astype(float)).max()) * float(np.abs(vectors.astype(float)).max()) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if most < 2**62:
        return queries @ vectors.T
    wide = queries.astype(object) @ vectors.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best partners of each query.

    Queries are the rows whose id is divisible by ``query_every``; partners are
    all rows with another id. Components are floor(scale * x). Ties go to the
    smaller id. A query with fewer than ``k`` partners gets them all. Rows whose
    id or vector is null, or whose vector has a null or non-finite component, take
    no part. Rows that repeat id and vector count once; rows of one id with other
    vectors are partners of their own, and a query with several vectors gets the
    best pairs of them all. A vector shorter than the longest counts as if it ended in zeros. No queries give no rows.

    Pivots come from at most ``SAMPLE`` queries; at most ``MOST_PIVOTS`` groups
    are described to the tasks. Blocks are cut by the hash of an id, so equal or
    crowded vectors are spread over tasks like any others.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), finite_vector(F.col(vector_col), scale).alias("vector")
    ).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    queries = rows.where(is_query)
    total, n_queries, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("vector"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    wanted = min(max(LEAST_PIVOTS, -(-n_queries // BLOCK_QUERIES)), MOST_PIVOTS)
    picked = queries.select("vector").limit(SAMPLE).toArrow()["vector"].combine_chunks()
    cells = Groups(make_pivots(matrix(picked, width), wanted))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            group, apart = cells.nearest(matrix(batch.column(1), width))
            yield {"vec_id": batch.column(0), "vector": batch.column(1), "cell": group.astype(np.int32), "apart": apart}

    assigned = arrow_map(queries, assign, "vec_id long, vector array<long>, cell int, apart double")
    n = len(cells.pivots)
    radius, blocks = np.zeros(n), np.zeros(n, dtype=np.int64)
    for cell, far, count in assigned.groupBy("cell").agg(F.max("apart"), F.count("*")).collect():
        radius[cell], blocks[cell] = far * (1 + _SLACK) + _SLACK, -(-count // BLOCK_QUERIES)
    known = Groups(cells.pivots, radius, blocks)

    def least_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        best: list[dict[int, float]] = [{} for _ in range(n)]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            low, _ = known.bounds(matrix(batch.column(1), width))
            for cell in np.flatnonzero(blocks):
                # k other ids reach what the (k + 1)-th best id does, each with one row at least
                order = np.argsort(-low[:, cell], kind="stable")
                for i in order:
                    own = best[cell]
                    if len(own) > k and low[i, cell] <= min(own.values()):
                        break
                    own[int(ids[i])] = max(low[i, cell], own.get(int(ids[i]), -np.inf))
                    if len(own) > k + 1:
                        del own[min(own, key=own.get)]
        flat = [(cell, i, s) for cell, own in enumerate(best) for i, s in own.items()]
        yield {"cell": [x[0] for x in flat], "vec_id": [x[1] for x in flat], "low": [x[2] for x in flat]}

    lows = arrow_map(rows, least_scores, "cell int, vec_id long, low double").groupBy("cell", "vec_id").agg(F.max("low").alias("low"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low"), "vec_id"))
    reached = np.full(n, -np.inf)
    for cell, low in lows.select("cell", "low", place.alias("place")).where(F.col("place") == k + 1).select("cell", "low").collect():
        reached[cell] = low
    shared = spark.sparkContext.broadcast(Groups(cells.pivots, radius, blocks, reached))
    chunks = -(-total // BLOCK_VECTORS)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        groups = shared.value
        for batch in batches:
            _, high = groups.bounds(matrix(batch.column(1), width))
            cells = np.flatnonzero(groups.blocks)
            for cell in cells:
                needed = np.flatnonzero(high[:, cell] >= groups.reached[cell])
                part = batch.take(pa.array(needed))
                for block in range(groups.blocks[cell]):
                    yield {
                        "vec_id": part.column(0),
                        "vector": part.column(1),
                        "cell": np.full(len(needed), cell, dtype=np.int32),
                        "block": np.full(len(needed), block, dtype=np.int32),
                    }

    def distinct_rows(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of the rows, equal ones once, by id."""
        rows = np.column_stack([part["vec_id"].to_numpy(), matrix(part["vector"].combine_chunks(), width)])
        rows = np.unique(rows, axis=0)
        return rows[:, 0], rows[:, 1:]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            (own, asked), (ids, vectors) = distinct_rows(left), distinct_rows(right)
            for query, line in zip(own, inner_products(asked, vectors), strict=True):
                others = np.flatnonzero(ids != query)
                # ~x falls as x rises, at the ends of the range too
                order = others[np.argsort(~line[others], kind="stable")[:k]]
                found += [(int(query), int(ids[i]), int(line[i])) for i in order]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    sent = arrow_map(rows, replicate, "vec_id long, vector array<long>, cell int, block int").withColumn("chunk", chunk)
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.element_at(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("cell") + 1))
    asked = assigned.select(
        "vec_id", "vector", "cell", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    )
    keys = ("cell", "block", "chunk")
    solved = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

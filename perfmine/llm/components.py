"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfmine.llm.common import staged

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); the component is its smallest id.

    Union-find over tables: nodes point to the smallest node they know, first all
    larger neighbours of a node, then all smaller ones, until nothing changes.
    The number of rows never rises above that of the edges. Minima combine before
    the shuffle and the joins have one row per node on one side, so a node with
    very many neighbours is not gathered anywhere. Edges with a null end and from
    a node to itself count for nothing.
    """
    links = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    for _ in range(MOST_ROUNDS):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links-up")
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        pairs = up.join(least, "u")
        down = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = staged(down.distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    links = links.distinct()
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def _settled(links: DataFrame) -> bool:
    """Whether every node that points somewhere points to one node, which points nowhere."""
    ends = links.select("u", F.col("v").alias("to")).unionByName(links.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("to")))
    nodes = ends.groupBy("u").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.bool_or(F.col("to").isNull()).alias("root"))
    return nodes.where("low <> high or (low is not null and root)").isEmpty()

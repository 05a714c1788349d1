"""Registry of the queries over the driver tables and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from perfmine.queries.bindings import BINDINGS, tables_of


@dataclass(frozen=True)
class Inputs:
    """Access to one folder of driver tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in tables_of(text):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def bind(self, name: str) -> DataFrame:
        return self.sql(BINDINGS[name])


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame``; ``oracle`` may use any binding as a table."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            _ORACLES[name] = with_bindings(oracle)
        return fn

    return register


def with_bindings(sql: str) -> str:
    """Put the blocks a statement names in front of it as CTEs."""
    used = [name for name in BINDINGS if name in _words(sql)]
    ctes = [f"{name} as ({BINDINGS[name].strip()})" for name in used]
    body = sql.strip()
    if ctes and body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[15:]
    if ctes and body.lower().startswith("with \nrecursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[16:]
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body


def _words(sql: str) -> set[str]:
    for mark in "(),.;\n":
        sql = sql.replace(mark, " ")
    return set(sql.split())


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from perfmine.queries import (  # noqa: F401
        buildconf, changes, dataset, evaluation, measurement, mining, reports, streams,
    )

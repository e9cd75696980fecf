"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.schema import SQL_GRAPH, edges_of, nodes_of
from codeloom.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Registers a query under its function's name; ``sql`` is its oracle, put behind the graph's common table expressions n and e."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        QUERIES[f.__name__] = run
        if sql is not None:
            body = sql.strip()
            if graph:
                body = f"WITH RECURSIVE {SQL_GRAPH}, {body[5:]}" if body.startswith("WITH ") else f"WITH {SQL_GRAPH} {body}"
            ORACLES[f.__name__] = body
        return f

    return add


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nodes_of(table(spark, folder, "nodes"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges_of(table(spark, folder, "edges"))

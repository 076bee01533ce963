"""Registry of the queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its checking SQL if there is one."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def union_sql(template: str, names: list[str]) -> str:
    """The template once per name (as ``{c}``), glued by UNION ALL."""
    return "\nUNION ALL\n".join(template.format(c=c) for c in names)


def decimal_round(expression: str, digits: int) -> str:
    """SQL that rounds a double by its shortest decimal text, halves up, as Spark does."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from sondeo.plans import (  # noqa: F401 - importing registers the queries
        queries_clean,
        queries_domain,
        queries_explore,
        queries_features,
        queries_models,
        queries_profile,
        queries_series,
        queries_store,
    )

    return dict(QUERIES), dict(ORACLES)

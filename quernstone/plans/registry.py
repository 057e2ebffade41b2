"""Registry of queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.operators import filters, labels
from quernstone.plans import standins

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under name, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str, threshold: int) -> DataFrame:
    """Labels left by the iterative frequency filter over vulnerable samples, with counts and first descriptions."""
    kept, _, _ = filters.iterative_frequency(standins.described(spark, sf_dir).filter("target = 1"), threshold)
    return labels.first_descriptions(kept).select("label", "n", F.coalesce("description", F.lit("")).alias("description"))


def queries() -> dict[str, Query]:
    """All registered queries."""
    from quernstone.plans import queries_data, queries_judges, queries_labels, queries_text  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that have one."""
    queries()
    return dict(_SQL)

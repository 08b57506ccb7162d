"""Queries over the views, by name, with the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.plans.views import CTE, Views

_QUERIES: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the columns of its SQL that are rounded to 6 digits, as all double columns of the query are."""

    def add(f: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        text = None
        if sql is not None:
            replaced = ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in doubles.split())
            text = f"{CTE}, result AS (\n{sql.strip()}\n)\nSELECT * {f'REPLACE ({replaced}) ' if replaced else ''}FROM result"
        _QUERIES[name] = (f, text)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select([(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _load() -> None:
    from waymark.plans import analysis, ingest, joins  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, f=f: rounded(f(Views(spark, sf_dir)))) for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: sql for n, (_, sql) in _QUERIES.items() if sql is not None}

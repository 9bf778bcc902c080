"""Registered queries: each is a function of Tables, with the SQL it must agree with where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables, with_views

FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, *views: str) -> Callable:
    """Registers a query under its function's name; `views` are the derived tables that the SQL reads."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        text = sql
        if sql and views:
            start = with_views(*views)
            text = f"{start},\n{sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f"{start}\n{sql}"
        FOUND[f.__name__] = f, text
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, sf_dir: f(Tables(spark, sf_dir)))(f) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}

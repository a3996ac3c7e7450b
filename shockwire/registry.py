"""Every query of the library with its SQL, for the driver and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir), with SQL for the same rows where SQL can express them."""

    def keep(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    from shockwire.plans import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)

"""The registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under a name, with the DuckDB SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def load() -> None:
    """Import the plan modules, which register their queries."""
    from importlib import import_module

    for name in PLANS:
        import_module(f"terrace.plans.{name}")


PLANS = ("q_tables", "q_scalars", "q_features", "q_text_models", "q_jobs")

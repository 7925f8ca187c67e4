"""Query plans: compositions of the operators over the test tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def register(theme: str) -> Callable:
    """A decorator that registers a query of a theme with its SQL (None where SQL can't express it)."""

    def with_sql(sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            if fn.__name__ in QUERIES:
                raise ValueError(f"{fn.__name__} is registered twice")
            fn.theme = theme
            QUERIES[fn.__name__] = fn
            if sql:
                ORACLE_SQL[fn.__name__] = sql
            return fn

        return add

    return with_sql


def sql_cte(*parts: str) -> str:
    """Common table expressions, and the query over them last."""
    return f"WITH {', '.join(parts[:-1])}\n{parts[-1]}" if len(parts) > 1 else parts[0]

"""How a module of plans registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from skyobs.operators.simulate import rounded


def registry(digits: int = 6) -> tuple[dict, dict[str, str], Callable]:
    """Queries and their SQL twins by name, and a decorator that fills them; doubles are rounded to `digits` unless it says otherwise."""
    queries: dict = {}
    twins: dict[str, str] = {}

    def query(name: str, sql: str | None = None, digits: int = digits):
        def keep(fn):
            queries[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
            if sql:
                twins[name] = sql
            return fn

        return keep

    return queries, twins, query

"""How modules of queries register them."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, SQL, a decorator that adds to both; without SQL to the first)."""
    queries, statements = {}, {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return add

    return queries, statements, query

"""The registered queries and their SQL, by name."""

from __future__ import annotations

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the same query for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add

"""Where queries are registered, each with the same result in DuckDB SQL where SQL can state it."""

from __future__ import annotations

from .sql import with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, extra: str = ""):
    """Registers a function of (spark, sf_dir); extra: further common table expressions of its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_tables(sql, extra)
        return f

    return keep

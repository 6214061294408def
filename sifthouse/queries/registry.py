"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tokens of a text, as both engines find them.
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def query(sql: str | None = None):
    """Register the function under its own name, with ``sql`` if there is any."""
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put

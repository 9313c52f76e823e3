"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from . import relational, retrieval, text_queries

_ALL = {**retrieval.QUERIES, **relational.QUERIES, **text_queries.QUERIES}


def queries() -> dict[str, Callable]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

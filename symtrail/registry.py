"""Where queries are registered, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.adapters import FACTS_SQL, star_facts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ENTRY_SQL = "(SELECT qualified FROM symbols WHERE id = 0)"


def query(sql: str | None = None, facts: bool = True):
    """Register a function of the facts (or of spark and sf_dir) under its name, with its SQL."""

    def add(f):
        name = f.__name__
        _QUERIES[name] = (lambda spark, sf_dir: f(star_facts(spark, sf_dir))) if facts else f
        if sql is not None:
            _SQL[name] = FACTS_SQL + sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)

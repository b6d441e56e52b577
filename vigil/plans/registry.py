"""Registry of named queries and their DuckDB oracles.

Each query is ``(spark, sf_dir) -> DataFrame`` over the driver tables (or
views Spark derives from them) and outputs scalar columns only: timestamps
as text, doubles rounded, arrays joined.  ``oracle`` is the equivalent
DuckDB SQL; queries that SQL cannot express have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def ts_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def load_all() -> None:
    """Import every module that registers queries."""
    from vigil.plans import q_state  # noqa: F401  (registers views used below)
    from vigil.plans import (chain, q_core, q_functions, q_notify,  # noqa: F401
                             q_sources, q_scoring, q_sinks, q_streaming)

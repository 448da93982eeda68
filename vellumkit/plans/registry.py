"""Queries of the engine over the driver's tables and their DuckDB counterparts, by name.

The tables are text and TPC-H-like; boxes, answers and polygons are derived from their columns by integer arithmetic that
both engines share. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


#: Tables of few bytes a row whose rows are parsed, matched and drawn.
NARROW = {"part", "supplier"}


class Tables:
    """``t.orders`` reads a table of the folder; those of ``NARROW`` come in tasks of a number of rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = table(self.spark, self._dir, name)
        return spread(df) if name in NARROW else df


def _run(f: Callable[[Tables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(Tables(spark, sf_dir))


def query(sql: str | None = None) -> Callable:
    """Register a function of the tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = partial(_run, f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from . import benchmark_queries, curation_queries, evaluation_queries, message_queries, sample_queries, source_queries  # noqa: E402, F401

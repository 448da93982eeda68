"""Exact ranks over skewed groups without a single-task window.

``row_number() over (partition by g)`` puts a whole group in one task. Here rows are range-partitioned by
(group, key), so that a hot group spreads over many tasks, and a rank is the row's place in its partition plus the
number of its group's rows in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import checkpoint, join_checked

P = 2147483647


def mixed_key(col: str, seed: int) -> F.Column:
    """Seeded shuffle key of an integer column, from 64-bit arithmetic that any SQL engine has. Null for null."""
    x = F.pmod(F.col(col).cast("bigint"), F.lit(P).cast("bigint"))
    for mult, shift in ((48271, 15), (69621, 13), (16807, 11)):
        x = (x * F.lit(mult).cast("bigint") + F.lit(seed).cast("bigint")) % F.lit(P).cast("bigint")
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def mixed_key_sql(col: str, seed: int) -> str:
    """The same key in DuckDB SQL."""
    x = f"((({col}::BIGINT % {P}) + {P}) % {P})"
    for mult, shift in ((48271, 15), (69621, 13), (16807, 11)):
        y = f"((({x}) * {mult} + {seed}) % {P})"
        x = f"xor({y}, {y} >> {shift})"
    return x


def rank_within(df: DataFrame, group: str | None, order: list[str], rank: str = "rank", count: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row in its group (nulls are a group; null keys first), and the group's size.

    Equal keys get different ranks, in no fixed order: pass enough columns in ``order``. ``group=None`` ranks all rows.
    """
    cols = [group, *order] if group else order
    rows = checkpoint(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in cols]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in cols]))
    g = F.col(group) if group else F.lit(0)
    rows = rows.withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id(), "__g": g})
    w = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("__g", "__pid").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
        .select("__g", "__pid", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__g")).alias("__total"))
        .withColumnsRenamed({"__g": "__sg", "__pid": "__spid"})
    )
    starts = checkpoint(starts)  # a row for each (partition, group) that occurs: about partitions + groups
    on = rows["__g"].eqNullSafe(starts["__sg"]) & (rows["__pid"] == starts["__spid"])
    out = join_checked(rows, starts, on, "inner", 100).withColumn(rank, F.col("__before") + F.col("__at") - F.col("__first"))
    if count:
        out = out.withColumn(count, F.col("__total"))
    return out.drop("__pid", "__at", "__g", "__sg", "__spid", "__first", "__before", "__total")

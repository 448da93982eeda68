"""Sharding by proportional stratified interleaving.

Documents are shuffled by a seeded key and ranked within their source; sorting all by the fractional rank
(rank + 0.5) / size of the source interleaves the sources in proportion, so that each cut of that order has the
mixture of the whole, to within two documents a source. Only ids, sources and keys are shuffled for the ranks, by range,
so a hot source spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import mixed_key, mixed_key_sql, rank_within
from ..runtime import checkpoint, join_checked, prepare

SHARD_ROWS, SEED = 2048, 17


def sources_of(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, key), a row for each doc_id: rows that repeat one are one document, with its least source."""
    ids = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.col("source").cast("string")).alias("source"))
    return ids.withColumn("key", mixed_key("doc_id", seed))


def shard_assignment(docs: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, shard, position): n documents in ceil(n / shard_rows) shards, whose sizes differ by one at most;
    position is the place in the shard.

    Ties of the fractional rank are broken by source. A null source is a source of its own; null doc_ids are one document.
    An empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    ranked = rank_within(sources_of(docs, seed), "source", ["key", "doc_id"], "rank", "size")
    ranked = ranked.withColumn("at", (F.col("rank") + 0.5) / F.col("size"))
    placed = rank_within(ranked, None, ["at", "source", "doc_id"], "place", "n")
    shards = F.ceil(F.col("n") / F.lit(shard_rows))
    # shard = floor(place * shards / n), and a shard starts at ceil(shard * n / shards)
    placed = placed.withColumn("shards", shards).withColumn("shard", F.expr("cast(place as decimal(38,0)) * shards div n"))
    first = F.expr("(cast(shard as decimal(38,0)) * n + shards - 1) div shards")
    return placed.select("doc_id", "source", F.col("shard").cast("bigint").alias("shard"), (F.col("place") - first).cast("bigint").alias("position"))


def shard(docs: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with columns shard and position (of these names, columns of ``docs`` are replaced; other names don't matter), each shard
    in one partition and in order. Rows that repeat a doc_id share its place, as do those of a null doc_id; a null source is a source of
    its own; nulls in other columns and texts of any length don't matter. An empty table stays empty.

    Texts are shuffled once, to their shards, while the places fit the checked broadcast; beyond it once more, by doc_id.
    """
    placed = checkpoint(shard_assignment(docs, shard_rows, seed).select(F.col("doc_id").alias("__doc"), "shard", "position"))
    kept = docs.drop("shard", "position")
    out = join_checked(kept, placed, kept["doc_id"].eqNullSafe(placed["__doc"]), "inner", 60).drop(placed["__doc"])
    return out.repartition("shard").sortWithinPartitions("shard", "position")


def oracle_sql(shard_rows: int = SHARD_ROWS, seed: int = SEED) -> str:
    """``shard_assignment`` over the table documents in DuckDB SQL."""
    return f"""
    WITH ids AS (SELECT doc_id, min(source) AS source, {mixed_key_sql("doc_id", seed)} AS k FROM documents GROUP BY doc_id),
    ranked AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY k NULLS FIRST, doc_id NULLS FIRST) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM ids),
    placed AS (SELECT doc_id, source, row_number() OVER (ORDER BY f, source NULLS FIRST, doc_id NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM ranked),
    cut AS (SELECT *, (n + {shard_rows - 1}) // {shard_rows} AS m, p * ((n + {shard_rows - 1}) // {shard_rows}) // n AS shard FROM placed)
    SELECT doc_id, source, shard::BIGINT AS shard, (p - (shard * n + m - 1) // m)::BIGINT AS position FROM cut"""

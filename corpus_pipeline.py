"""A training-data pipeline over the table ``documents``: each stage reads what the one before it wrote.

A stage takes any documents. A null text is never rejected; null ids have no duplicates and share one place in the mixture and in
a shard; a null source is a source of its own; nulls elsewhere, empty and very long texts and further columns, whatever their
names, pass through. Of rows that repeat a doc_id one stays from the second stage on. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumkit.llm import decontamination, mixing, sharding, simhash, toxicity
from vellumkit.runtime import removed, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on ``labels``, doesn't find toxic; null texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the least doc_id; null ids and texts stay."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; null texts stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the splitting tree draws to meet the target weights, in its shards' order; a null source is a source of its own."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shard and position."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Neither the factorization machine nor SimHash can be put in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written as Parquet to the shared folder, where only those
    that the last stage reads stay behind."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = stored(docs, name)
            if before:
                removed(spark, before)
            before = path
    return docs

"""Documents with every awkward case: nulls in each column, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["score", "toxic", "group_id", "kept", "__gone", "__again", "anchor", "u", "v", "key", "rank", "shard", "__key", "__source0", "__cut0", "__doc", "__id", "__in", "inside", "word", "id", "item_id"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def text(seed: int, n: int = 60) -> str:
    return " ".join(words(random.Random(seed), n))


def edited(s: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() >= share else words(rng, 1)[0] for w in s.split())


def edge_rows() -> list[tuple]:
    return [
        (None, "text of no id " + text(1), "en", "a", 9), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t", None, "a", 5), (4, text(4), "en", None, 9), (5, text(5), "de", "b", 9), (5, text(5), "de", "b", 9),
        (6, text(6, 60_000), "en", "b", 400_000), (7, "!!!", "xx", "b", 3), (8, "é İ ß \U0001f600 " + text(8), "en", "c", 9), (None, None, None, None, None), (-9, text(9), "en", "c", 9),
    ]


def edge_docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)

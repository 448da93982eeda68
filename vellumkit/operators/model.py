"""The boundary to a model: row to row, batch by batch; and the bounded zoom loop around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..runtime import checkpoint

Model = Callable[[pd.DataFrame], pd.Series]

MODELS: dict[str, Callable[[], Model]] = {}


def register(name: str, factory: Callable[[], Model]) -> None:
    """Make a model known by name (E4); the factory runs once a task."""
    MODELS[name] = factory


def echo_model() -> Model:
    """Stub: answers with the prompt's first box, else its last word. Deterministic."""
    return lambda b: b["prompt"].map(lambda p: (p or "").split("]")[0].split("[")[-1].join("[]") if p and "[" in p else (p or "").split(" ")[-1])


register("echo", echo_model)


def infer(df: DataFrame, model: str | Callable[[], Model], out: str = "output") -> DataFrame:
    """Column ``out`` with the model's answers (E4, E5, T4); the batch size is spark.sql.execution.arrow.maxRecordsPerBatch."""
    factory = MODELS[model] if isinstance(model, str) else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = factory()
        for b in batches:
            yield b.assign(**{out: f(b)})

    kept = df.drop(out)
    from pyspark.sql.types import StringType, StructField, StructType

    return kept.mapInPandas(run, StructType([*kept.schema.fields, StructField(out, StringType())]))


def zoom_loop(df: DataFrame, model: str | Callable[[], Model], rounds: int = 3) -> DataFrame:
    """Answers with a tool call are asked again about the region they name, at most ``rounds`` times (E5, X11); others are
    done. Column rounds: how many answers it took. Each round works only on the rows that are left."""
    left, done = infer(df, model).withColumn("rounds", F.lit(1)), None
    for k in range(2, rounds + 1):
        left = checkpoint(left)
        again = F.contains("output", F.lit("<tool_call>"))
        ready = left.where(F.coalesce(~again, F.lit(True)))
        done = ready if done is None else done.unionByName(ready)
        zoomed = left.where(again).withColumn("prompt", F.concat("prompt", F.lit(" zoom "), F.coalesce(T.tool_call_box(F.col("output")).cast("string"), F.lit("[whole]"))))
        left = infer(zoomed.drop("rounds"), model).withColumn("rounds", F.lit(k))
    return left if done is None else done.unionByName(left)

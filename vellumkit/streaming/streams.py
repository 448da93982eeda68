"""Structured Streaming: packing with carried state, and windowed counts of late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packing import pack_interval

PACKED = "shard int, group_id bigint, members array<struct<id: bigint, length: bigint>>, total bigint"


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours", value: str = "value") -> DataFrame:
    """(window_start, by, n, total of ``value``) of a stream of events; rows later than the watermark are dropped. A timestamp without
    time zone is read as UTC, as a watermark needs one with it."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = e.groupBy(F.window("__ts", width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), by, "n", "total")


def pack_stream(samples: DataFrame, shards: int = 8, interval: int = 64, capacity: int = 4096, idle: str | None = None) -> DataFrame:
    """Packs a stream of (id, length) as it comes (T1): each shard keeps the samples of an unfinished interval and its last
    bin as state, and emits the other bins. With ``idle``, a shard that sees no data for so many milliseconds is flushed."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, lengths, done = state.get if state.exists else ([], [], 0)
        buffer, out = list(zip(ids, lengths)), []
        if state.hasTimedOut:
            groups, buffer = pack_interval(buffer, capacity, True)
            out += groups
            state.remove()
        else:
            for b in batches:
                for i, n in sorted(zip(b["id"].tolist(), b["length"].tolist())):
                    buffer.append((int(i), int(n)))
                    if len(buffer) >= interval:
                        groups, buffer = pack_interval(buffer, capacity, False)
                        out += groups
            state.update(([i for i, _ in buffer], [n for _, n in buffer], done + len(out)))
            if idle:
                state.setTimeoutDuration(int(idle))
        rows = [(key[0], done + k, [{"id": i, "length": n} for i, n in g], sum(n for _, n in g)) for k, g in enumerate(out)]
        yield pd.DataFrame(rows, columns=["shard", "group_id", "members", "total"])

    keyed = samples.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("bigint").alias("id"), F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return keyed.groupBy("shard").applyInPandasWithState(run, PACKED, "ids array<bigint>, lengths array<bigint>, done bigint", "append", timeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a bounded stream gives, as a temporary table (for tests and smoke runs)."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.table(name)

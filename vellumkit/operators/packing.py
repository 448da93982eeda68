"""Packing of samples into sequences of fixed length, and the arrays of a packed batch."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def pack_best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers (T2): items by falling length, each into the fullest bin with room, else a new one. An item longer
    than the capacity has a bin of its own. O(n log n): the bins are kept sorted by room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        at = bisect_left(room, (n, -1))
        if n <= capacity and at < len(room):
            left, b = room.pop(at)
            bins[b].append(k)
            insort(room, (left - n, b))
        else:
            bins.append([k])
            insort(room, (capacity - n, len(bins) - 1))
    return bins


def pack_interval(buffer: list[tuple], capacity: int, final: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Groups of (..., length) samples, and what is carried to the next interval: the last bin, unless it is final."""
    groups = [[buffer[k] for k in b] for b in pack_best_fit([int(s[-1]) for s in buffer], capacity)]
    return (groups, []) if final or not groups else (groups[:-1], groups[-1])


#: Rows of a shard, where their number isn't given.
SHARD_ROWS = 1 << 17


def pack(df: DataFrame, id_col: str, length: str, order: str, shards: int | None = None, interval: int = 64, capacity: int = 4096) -> DataFrame:
    """(shard, group_id, members array<struct<id, length>>, total): each shard packs its rows in ``order``, ``interval`` at a time, and
    carries its last bin on, so the memory of a task is one interval. Null lengths count as 0. Without ``shards``, there is one for each
    ``SHARD_ROWS`` rows, so that tasks grow with the table."""
    shards = shards or max(1, -(-df.count() // SHARD_ROWS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple[list, int]] = {}

        def rows(shard: int, groups: list, first: int) -> list[tuple]:
            return [(shard, first + k, [{"id": int(i), "length": int(n)} for i, n in g], sum(n for _, n in g)) for k, g in enumerate(groups)]

        for b in batches:
            out = []
            for shard, i, n in zip(b["shard"].tolist(), b["id"].tolist(), b["length"].tolist()):
                for old in [s for s in state if s != shard]:  # rows come sorted by shard
                    buffer, done = state.pop(old)
                    out += rows(old, pack_interval(buffer, capacity, True)[0], done)
                buffer, done = state.setdefault(shard, ([], 0))
                buffer.append((i, n))
                if len(buffer) >= interval:
                    groups, rest = pack_interval(buffer, capacity, False)
                    out += rows(shard, groups, done)
                    state[shard] = (rest, done + len(groups))
            yield pd.DataFrame(out, columns=["shard", "group_id", "members", "total"])
        out = [r for s, (buffer, done) in state.items() for r in rows(s, pack_interval(buffer, capacity, True)[0], done)]
        yield pd.DataFrame(out, columns=["shard", "group_id", "members", "total"])

    rows_in = df.select(F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("length"), F.col(order).alias("__o"))
    sorted_in = rows_in.repartition(shards, "shard").sortWithinPartitions("shard", "__o", "id").select("shard", "id", "length")
    return sorted_in.mapInPandas(run, "shard int, group_id bigint, members array<struct<id: bigint, length: bigint>>, total bigint")


def length_extremes(groups: DataFrame, total: str, n: int = 10) -> DataFrame:
    """The n shortest and n longest packed lengths."""
    low = groups.orderBy(total).limit(n).select(F.lit("smallest").alias("side"), total)
    return low.unionByName(groups.orderBy(F.desc(total)).limit(n).select(F.lit("largest").alias("side"), total))


# --- arrays of a packed group --------------------------------------------------------------------------------------


def pad_batch(df: DataFrame, batch: str, ids: str, labels: str, pad_id: int = 0, ignore: int = -100) -> DataFrame:
    """input_ids, labels, attention_mask, position_ids padded on the right to the longest of the batch (R2)."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    n = F.size(ids)
    fill = lambda v: F.array_repeat(F.lit(v), longest - n)
    ones = F.transform(F.col(ids), lambda _: F.lit(1))
    return df.withColumns({
        "input_ids": F.concat(F.col(ids), fill(pad_id)), "labels": F.concat(F.col(labels), fill(ignore)), "attention_mask": F.concat(ones, fill(0)),
        "position_ids": F.concat(F.transform(F.col(ids), lambda _, i: i), fill(1)),
    })


def mask_first(labels: Column, ignore: int = -100) -> Column:
    """The first label of a packed sample is ignored."""
    return F.when(F.size(labels) > 0, F.concat(F.array(F.lit(ignore)), F.slice(labels, 2, 1 << 30))).otherwise(labels)


def mask_labels(ids: Column, is_label: Column, ignore: int = -100) -> Column:
    """Tokens outside the answers are ignored."""
    return F.zip_with(ids, is_label, lambda t, k: F.when(k, t).otherwise(F.lit(ignore)))


def flatten_group(df: DataFrame, group: str, order: str, ids: str, labels: str, max_length: int | None = None) -> DataFrame:
    """One sequence a group: ids and labels in order, example numbers and positions within the examples."""
    g = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), mask_first(F.col(labels)).alias("l")))).alias("m"))
    cut = lambda c: F.slice(c, 1, max_length) if max_length else c
    return g.select(
        group, cut(F.flatten(F.transform("m", lambda e: e["i"]))).alias("input_ids"), cut(F.flatten(F.transform("m", lambda e: e["l"]))).alias("labels"),
        cut(F.flatten(F.transform("m", lambda e, k: F.transform(e["i"], lambda _: k)))).alias("example_ids"), cut(F.flatten(F.transform("m", lambda e: F.transform(e["i"], lambda _, i: i)))).alias("position_ids"),
    )


def replace_overlong(df: DataFrame, batch: str, length: str, id_col: str, max_length: int) -> DataFrame:
    """Column source_id: rows over the limit take the place of one of the batch's other rows, chosen by hash; null if there is none."""
    w = Window.partitionBy(batch)
    fits = F.sort_array(F.collect_list(F.when(F.col(length) <= max_length, F.col(id_col))).over(w))
    pick = F.get(fits, F.pmod(F.xxhash64(id_col), F.size(fits)).cast("int"))
    return df.withColumn("source_id", F.when(F.col(length) <= max_length, F.col(id_col)).when(F.size(fits) > 0, pick))

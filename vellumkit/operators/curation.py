"""Dedup, split, sampling, ranking and sharding of annotation rows. Order keys are explicit: a hash of the id and a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import join_checked, prepare
from .ranking import mixed_key, rank_within


def dedup_keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order`` (W3, U5). Null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def shard_contiguous(df: DataFrame, shards: int, order: list[str], out: str = "shard") -> DataFrame:
    """n contiguous parts of near-equal size, the first ones a row longer (W5): ntile without its single-task window."""
    r = rank_within(df, None, order, "__r", "__n")
    size, more = F.floor(F.col("__n") / F.lit(shards)), F.col("__n") % F.lit(shards)
    head = more * (size + 1)
    shard = F.when(F.col("__r") < head, F.floor(F.col("__r") / (size + 1))).otherwise(more + F.floor((F.col("__r") - head) / size))
    return r.withColumn(out, shard.cast("int")).drop("__r", "__n")


def shard_round_robin(df: DataFrame, shards: int, idx: str = "idx", out: str = "shard") -> DataFrame:
    """idx mod shards."""
    return df.withColumn(out, F.pmod(F.col(idx), F.lit(shards)).cast("int"))


def with_dense_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """0-based dense index in ``order``."""
    return rank_within(df, None, order, out)


def sample_exact(df: DataFrame, rate: float, id_col: str, seed: int = 42, at_least: int = 0) -> DataFrame:
    """Exactly int(n * rate) rows, by seeded order; different seeds differ (O6; ``at_least=1``: O8)."""
    if not 0 <= rate <= 1:
        raise ValueError(f"rate {rate} isn't in [0, 1]")
    r = rank_within(df.withColumn("__k", mixed_key(id_col, seed)), None, ["__k", id_col], "__r", "__n")
    return r.where(F.col("__r") < F.greatest(F.floor(F.col("__n") * F.lit(rate)), F.lit(at_least))).drop("__k", "__r", "__n")


def oversample(df: DataFrame, times: float, out: str = "copy") -> DataFrame:
    """Each row ``times`` times; only whole numbers."""
    if times != int(times) or times < 1:
        raise ValueError(f"oversampling must be a whole number of times, not {times}")
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(int(times)))))


def sample_by_rate(df: DataFrame, rate: float, id_col: str, seed: int = 42) -> DataFrame:
    """A rate up to 1 samples, a larger one oversamples."""
    return sample_exact(df, rate, id_col, seed) if rate <= 1 else oversample(df, rate).drop("copy")


def stratified_split(df: DataFrame, strata: str, ratio: float, id_col: str, seed: int = 42) -> DataFrame:
    """Column split: of each stratum the first int(n * ratio) in seeded order train, the rest test."""
    r = rank_within(df.withColumn("__k", mixed_key(id_col, seed)), strata, ["__k", id_col], "__r", "__n")
    return r.withColumn("split", F.when(F.col("__r") < F.floor(F.col("__n") * F.lit(ratio)), "train").otherwise("test")).drop("__k", "__r", "__n")


def shuffle_and_clip(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """The first n rows in seeded order (O5, O11): a top-n, never a full sort."""
    return df.orderBy(mixed_key(id_col, seed), id_col).limit(n)


def icl_select(df: DataFrame, response: Column, rank: list[Column | str], shots: int, unique: bool = False) -> DataFrame:
    """In-context examples: the first ``shots`` by rank; with ``unique``, the first of each response first, then the others
    (W1). Column shot: 0-based place."""
    if not unique:
        return _placed(df.orderBy(*rank).limit(shots), rank)
    w = Window.partitionBy(F.trim(F.lower(response))).orderBy(*rank)
    # No more than ``shots`` rows of a response can be chosen, so each response's rows are cut before the total order.
    r = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= shots).withColumn("__again", F.col("__rn") > 1)
    order = [F.col("__again"), *rank]
    return _placed(r.orderBy(*order).limit(shots), order).drop("__rn", "__again")


def _placed(df: DataFrame, order: list[Column | str]) -> DataFrame:
    return df.withColumn("shot", F.row_number().over(Window.orderBy(*order)) - 1)  # at most ``shots`` rows


def hard_examples(df: DataFrame, group: str, score: str, id_col: str, n: int) -> DataFrame:
    """Round r takes the r-th highest score of every group, until there are n."""
    w = Window.partitionBy(group).orderBy(F.desc(score), id_col)
    return df.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n).orderBy("round", F.desc(score), id_col).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name; a column that some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select("*") for f in frames])


def concat_index(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """lo and hi of each dataset's stretch of the global index (W9): one row a dataset."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum(size).over(w)
    return sizes.withColumns({"lo": hi - F.col(size), "hi": hi})


def locate(idx: DataFrame, sizes: DataFrame, order: str, size: str, key: str = "idx") -> DataFrame:
    """Global index to (dataset, local index) (J14): a range join with the few datasets."""
    bounds = concat_index(sizes, order, size)
    on = (F.col(key) >= F.col("lo")) & (F.col(key) < F.col("hi"))
    return join_checked(idx, bounds, on, "inner", 64).withColumn("local_idx", F.col(key) - F.col("lo")).drop("lo", "hi")


def mix_percent(df: DataFrame, by: str) -> DataFrame:
    """(by, n, percent)."""
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def expand_catalog(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests such as ``name%50``, ``name*3`` or ``all%10`` joined with the catalog (name, ...): a row for each dataset with its
    rate; ``all`` stands for the whole catalog (O9, J13)."""
    from ..functions.text import sampling_rate

    prepare(catalog.sparkSession)
    asked = requests.select(F.regexp_replace("request", r"[%*].*$", "").alias("asked"), sampling_rate(F.col("request")).alias("rate"))
    return join_checked(catalog, asked, (F.col("asked") == "all") | (F.col("asked") == F.col("name")), "inner").drop("asked")


def drop_malformed(df: DataFrame, box: str, least: int = 4) -> DataFrame:
    """Rows whose box has ``least`` numbers at least, none of them null (F7); null boxes go."""
    return df.where(F.coalesce((F.size(box) >= least) & F.forall(box, lambda v: v.isNotNull()), F.lit(False)))


def configs_by_type(catalog: DataFrame) -> DataFrame:
    """(dataset_type, configs): the catalog's entries grouped by the class that reads them, in order of their names."""
    rest = [c for c in catalog.columns if c != "dataset_type"]
    return catalog.groupBy("dataset_type").agg(F.array_sort(F.collect_list(F.struct("name", *[c for c in rest if c != "name"]))).alias("configs"))

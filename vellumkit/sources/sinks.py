"""Sinks: results, packed groups, splits, submission files, run manifests. All are written by the executors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import polygon_iou_np
from ..runtime import spread


def write_results(df: DataFrame, path: str, drop: tuple[str, ...] = ("content",)) -> None:
    """Inference results without binary columns."""
    df.drop(*drop).write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str, benchmark: str) -> None:
    """Tidy metrics (benchmark, metric, value, at), appended (K2): each numeric column of a one-row result is a metric."""
    names = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
    tidy = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(F.lit(benchmark).alias("benchmark"), "m.*", F.current_timestamp().alias("at"))
    tidy.write.mode("append").parquet(path)


def write_packed(groups: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Packed groups as JSON lines (K3)."""
    groups.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def write_arrays(df: DataFrame, path: str, ints: tuple[str, ...] = (), flags: tuple[str, ...] = (), rows_per_file: int = 50_000) -> None:
    """Token arrays, narrowed to 32 bits (flags: 16), in files of bounded size (K4)."""
    kinds = {c: "array<int>" for c in ints} | {c: "array<smallint>" for c in flags}
    df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_cache(groups: DataFrame, path: str, columns: list[str]) -> None:
    """Only the indices, or only the messages, of packed groups (K5, K6)."""
    groups.select(*columns).write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", allowed: tuple[str, ...] = ("train", "val", "test")) -> None:
    """A folder a split; an unknown split is an error."""
    ok = F.when(F.col(split).isin(*allowed), F.col(split)).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(F.col(split).cast("string"), F.lit("null")))))
    df.withColumn(split, ok).write.mode("overwrite").partitionBy(split).parquet(path)


def write_submission(dets: DataFrame, path: str) -> None:
    """"image score x1 ... y4" lines, a folder a class (K9). dets: image, class_name, score, poly."""
    line = F.concat_ws(" ", "image", F.format_string("%.4f", "score"), F.array_join(F.transform("poly", lambda v: F.format_string("%.2f", v.cast("double"))), " "))
    dets.select("class_name", line.alias("line")).write.mode("overwrite").partitionBy("class_name").text(path)


def merge_patches(dets: DataFrame, iou: float = 0.1) -> DataFrame:
    """Detections of patches named <image>__<scale>__<x>___<y>, in the coordinates of the image, without those that overlap a better one of
    the class by more than ``iou`` (K9). Names of another form are images of their own. Score ties go to the lesser polygon."""
    part = lambda k: F.regexp_extract("image", r"^(.*)__([0-9.]+)__(-?\d+)___(-?\d+)$", k)
    named = dets.select("*", *(part(k).alias(f"__{k}") for k in (1, 2, 3, 4)))
    patch = F.col("__1") != ""
    named = named.withColumns({"__shift": F.array(F.col("__3").try_cast("double"), F.col("__4").try_cast("double")), "__scale": F.col("__2").try_cast("double"), "__patch": patch})
    moved = F.transform("poly", lambda v, i: F.when(F.col("__patch"), (v + F.get("__shift", (i % 2).cast("int"))) / F.col("__scale")).otherwise(v.cast("double")))
    rows = named.select(F.when(patch, F.col("__1")).otherwise(F.col("image")).alias("image"), "class_name", F.col("score").cast("double").alias("score"), moved.alias("poly"))

    @F.pandas_udf("array<int>")
    def kept(groups: pd.Series) -> pd.Series:  # of each image and class, from the best detection down
        out = []
        for polys in groups:
            if polys is None:
                out.append(None)
                continue
            polys, own = [p.tolist() for p in polys], []
            for k, p in enumerate(polys):
                if all(polygon_iou_np(p, polys[j]) <= iou for j in own):
                    own.append(k)
            out.append(own)
        return pd.Series(out)

    found = F.struct(F.isnull("score").alias("none"), (-F.col("score")).alias("less"), "poly", "score")
    # By rows, as few bytes may be many groups; the group of one detection doesn't go to Python.
    groups = spread(rows, 1 << 13, ("image",)).groupBy("image", "class_name").agg(F.array_sort(F.collect_list(found)).alias("d"))
    groups = groups.withColumn("k", kept(F.when(F.size("d") > 1, F.col("d.poly"))))
    best = F.when(F.size("d") > 1, F.transform("k", lambda k: F.get("d", k))).otherwise(F.col("d"))
    return groups.select("image", "class_name", F.explode(best).alias("d")).select("image", "class_name", "d.score", "d.poly")


def write_ranked(df: DataFrame, path: str, score: str = "ppl") -> None:
    """Candidates by falling score."""
    df.orderBy(F.desc(score)).write.mode("overwrite").json(path)


def split_bad_records(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    flag = F.coalesce(ok, F.lit(False))
    return df.where(flag), df.where(~flag)


def pending(benchmarks: DataFrame, spark: SparkSession, manifest: str) -> DataFrame:
    """Benchmarks that the manifest doesn't list as done."""
    try:
        done = spark.read.parquet(manifest)
    except Exception as e:  # the first run has no manifest
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return benchmarks
    return benchmarks.join(done.select("benchmark").distinct(), "benchmark", "left_anti")


def mark_done(spark: SparkSession, manifest: str, benchmark: str) -> None:
    spark.createDataFrame([(benchmark,)], "benchmark string").write.mode("append").parquet(manifest)

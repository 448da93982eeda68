"""Matching of predicted and true boxes, and detection metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.geometry import box_giou, polygon_giou_np, polygon_iou_np
from ..functions.text import let
from ..runtime import checkpoint, join_checked
from .ranking import rank_within


def pair_matrix(pred: Column, gt: Column) -> Column:
    """array<struct<v, i, j>> of the GIoU of every pair of axis-aligned boxes of a row."""
    return F.flatten(F.transform(pred, lambda p, i: F.transform(gt, lambda g, j: F.struct(box_giou(p, g).alias("v"), i.cast("int").alias("i"), j.cast("int").alias("j")))))


def box_pairs(df: DataFrame, pred: str, gt: str, of_pred: Callable[[Column], Column] = lambda x: x, of_gt: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """The same as rows (i, j, v and the other columns), for many pairs: compiled, where ``pair_matrix`` is interpreted. Items of the two
    lists are boxes, or become boxes by the functions.

    ``geometry.box_giou`` by steps, a column each: as one expression it is spelled out to a method too long for the JVM's compiler.
    """
    rest, c, zero = [x for x in df.columns if x not in (pred, gt)], F.col, F.lit(0.0)
    d = df.select(*rest, c(gt).alias("__g"), F.posexplode(pred).alias("i", "__p")).select(*rest, "i", "__p", F.posexplode("__g").alias("j", "__t"))
    d = d.select(*rest, "i", "j", *[box[k].alias(f"__{n}{k}") for n, box in (("p", of_pred(c("__p"))), ("t", of_gt(c("__t")))) for k in range(4)])
    a, b = ([c(f"__{n}{k}") for k in range(4)] for n in "pt")
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    side = lambda k: F.greatest(F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]), zero)
    hull = lambda k: F.greatest(a[k + 2], b[k + 2]) - F.least(a[k], b[k])
    d = d.select(*rest, "i", "j", area(a).alias("__a"), area(b).alias("__b"), (side(0) * side(1)).alias("__i"), (hull(0) * hull(1)).alias("__h"), *[(a[k] - b[k]).alias(f"__d{k}") for k in range(4)])
    x0, y0, x1, y1 = (c(f"__d{k}") for k in range(4))
    cut = F.greatest(-x0 * y0, zero) + F.greatest(-x1 * y1, zero) + F.greatest(x1 * y0, zero) + F.greatest(x0 * y1, zero)
    d = d.select(*rest, "i", "j", "__a", "__b", "__i", (c("__a") + c("__b") - c("__i")).alias("__u"), (c("__h") - cut / 2).alias("__h"))
    v = F.when((c("__a") > 0) & (c("__b") > 0), c("__i") / c("__u") - (c("__h") - c("__u")) / c("__h")).otherwise(zero)
    return d.select(*rest, "i", "j", v.alias("v"))


def matched_boxes(pairs: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, hits): greedy matches of the pairs of each row of ``by`` (J10). Only pairs that reach the threshold, and the first, are gathered."""
    keep = (F.col("v") >= threshold) | ((F.col("i") == 0) & (F.col("j") == 0))
    near = pairs.select(*by, F.explode(F.when(keep, F.array(F.struct("v", "i", "j")))).alias("e"))  # a filter would be moved below the steps of v, and spell them out
    gathered = near.groupBy(*by).agg(F.collect_list(F.when(F.col("e.v") >= threshold, F.col("e"))).alias("__m"))
    hits = F.when(F.size("__m") < 2, F.size("__m")).otherwise(greedy_matches(F.col("__m"), threshold))
    return gathered.select(*by, hits.alias("hits"))


def greedy_matches(pairs: Column, threshold: float) -> Column:
    """Number of pairs when the best pair is taken again and again, and its row and column with it (J10). Ties: the least
    (i, j). A fold over the pairs sorted by value, in the row: no shuffle."""
    ok = F.filter(pairs, lambda e: e["v"] >= threshold)
    order = F.array_sort(F.transform(ok, lambda e: F.struct((-e["v"]).alias("k"), e["i"].alias("i"), e["j"].alias("j"))))
    empty = F.array().cast("array<int>")
    step = lambda a, e: F.when(F.array_contains(a["is"], e["i"]) | F.array_contains(a["js"], e["j"]), a).otherwise(F.struct(F.array_append(a["is"], e["i"]).alias("is"), F.array_append(a["js"], e["j"]).alias("js")))
    return F.size(F.aggregate(order, F.struct(empty.alias("is"), empty.alias("js")), step)["is"])


def _upright(*lists: Column) -> Column:
    """All boxes are axis-aligned ones of 4 numbers."""
    return F.forall(F.flatten(F.array(*[F.transform(x, F.size) for x in lists])), lambda n: n == 4)


@F.pandas_udf(T.IntegerType())
def _polygon_hits(pred: pd.Series, gt: pd.Series, threshold: pd.Series) -> pd.Series:
    """Number of greedy matches of each row's polygons; null where a list is null or a box has neither 4 nor 8 numbers."""
    out = []
    for p, g, t in zip(pred, gt, threshold):
        if p is None or g is None or any(len(x) not in (4, 8) for x in (*p, *g)):
            out.append(None)
            continue
        v = np.array([[polygon_giou_np(list(x), list(y)) for y in g] for x in p]).reshape(len(p), len(g))
        out.append(len(greedy_matches_np(v, t)))
    return pd.Series(out, dtype="Int32")


def referring_ok(pred: Column, gt: Column, threshold: float = 0.5) -> Column:
    """All boxes are found and no others (F1 = 1, A8); without a prediction, or an unreadable one, false.

    Boxes have 4 numbers (axis-aligned) or 8 (any quadrangle). Rows of the first kind alone are matched by expressions; only the others'
    boxes go to Python, and only if their number is right.
    """
    n = F.size(F.coalesce(pred, F.array().cast("array<array<double>>")))
    right, upright = (n > 0) & (n == F.size(gt)), _upright(pred, gt)
    doubles = lambda c: F.when(right & ~upright, c.cast("array<array<double>>"))
    hits = F.when(upright, greedy_matches(pair_matrix(pred, gt), threshold)).otherwise(_polygon_hits(doubles(pred), doubles(gt), F.lit(threshold)))
    return F.coalesce(right & (hits == n), F.lit(False))


def greedy_matches_np(values: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The same over a matrix, for general polygons."""
    v, out = np.array(values, float), []
    while v.size:
        k = int(v.argmax())
        i, j = divmod(k, v.shape[1])
        if v[i, j] < threshold:
            break
        out.append((i, j))
        v[i, :], v[:, j] = -np.inf, -np.inf
    return out


def polygon_matches(df: DataFrame, key: str, pred: str, gt: str, threshold: float = 0.5) -> DataFrame:
    """(key, n_pred, n_gt, tp) of rows with lists of polygons of 4 or 8 numbers."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p, g in zip(b[key], b[pred], b[gt]):
                p, g = ([] if x is None else list(x) for x in (p, g))
                v = np.array([[polygon_giou_np(list(x), list(y)) for y in g] for x in p]).reshape(len(p), len(g))
                rows.append((k, len(p), len(g), len(greedy_matches_np(v, threshold))))
            yield pd.DataFrame(rows, columns=[key, "n_pred", "n_gt", "tp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pred, gt).mapInPandas(match, f"{key} {kind}, n_pred int, n_gt int, tp int")


def _iou(p: Column, g: Column) -> Column:
    w = F.greatest(F.least(p[2], g[2]) - F.greatest(p[0], g[0]), F.lit(0.0))
    h = F.greatest(F.least(p[3], g[3]) - F.greatest(p[1], g[1]), F.lit(0.0))
    return let(w * h, lambda both: F.coalesce(F.try_divide(both, (p[2] - p[0]) * (p[3] - p[1]) + (g[2] - g[0]) * (g[3] - g[1]) - both), F.lit(0.0)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("v", T.DoubleType()), T.StructField("j", T.IntegerType())])))
def _polygon_best(pred: pd.Series, gt: pd.Series) -> pd.Series:
    """Of each predicted polygon, its largest IoU and minus the place of the first true one that has it, as a struct that orders alike."""
    out = []
    for p, g in zip(pred, gt):
        if p is None or g is None:
            out.append(None)
            continue
        own = []
        for x in p:
            v = [polygon_iou_np(list(x), list(y)) for y in g]
            own.append({"v": max(v), "j": -v.index(max(v))} if v else None)
        out.append(own)
    return pd.Series(out)


def _taken(best: Column, iou: float) -> Column:
    """The place of a detection's best box, null below the threshold."""
    return let(best, lambda m: F.when(m["v"] >= iou, m["j"]))


def assign_detections(df: DataFrame, image: str, cls: str, score: str, order: str, iou: float = 0.5) -> DataFrame:
    """Whether each detection is a hit (A21): in score order each takes its best true box of the same image and class, if
    its IoU reaches the threshold and the box is free. df: detections (box, kind 'pred') and truths (kind 'gt').

    Boxes have 4 numbers (axis-aligned) or 8 (any quadrangle, as of rotated boxes). The boxes of an image and class are gathered in
    a row and matched by a fold; only the overlaps of quadrangles are computed in Python. A row without a score counts the truths of its group.
    """
    pred, gt = F.col("kind") == "pred", F.col("kind") == "gt"
    g = df.groupBy(image, cls).agg(
        F.array_sort(F.collect_list(F.when(pred, F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), F.col("box").alias("b"))))).alias("p"), F.collect_list(F.when(gt, F.struct(F.col(order).alias("o"), F.col("box").alias("b")))).alias("g"),
    )
    g = g.withColumn("g", F.array_sort("g"))
    best = lambda p: F.array_max(F.transform("g", lambda t, j: F.struct(_iou(p["b"], t["b"]).alias("v"), (-j).alias("j"))))
    if df.where(F.size("box") != 4).isEmpty():
        taken = best
    else:
        of = lambda c: F.transform(c, lambda e: e["b"].cast("array<double>"))
        g = g.withColumn("__up", _upright(of("p"), of("g")))
        polygons = lambda c: F.when(~F.col("__up"), of(c))
        g = g.withColumn("__best", _polygon_best(polygons("p"), polygons("g")))
        taken = lambda p, k: F.when(F.col("__up"), best(p)).otherwise(F.get("__best", k))
    # Of those in score order that take one box, the first has it: a detection is a hit if the box isn't among those taken before it.
    g = g.withColumn("m", F.transform("p", (lambda p: _taken(taken(p), iou)) if taken is best else (lambda p, k: _taken(taken(p, k), iou))))
    none = lambda kind: F.lit(None).cast(kind)
    first = lambda k: (F.get("m", k).isNotNull() & (F.array_position("m", F.get("m", k)) == k + 1)).cast("int")
    hits = F.transform("p", lambda p, k: F.struct((-p["s"]).cast("double").alias(score), p["o"].cast("bigint").alias(order), F.coalesce(first(k), F.lit(0)).alias("tp"), F.lit(0).alias("n_gt")))
    head = F.array(F.struct(none("double").alias(score), none("bigint").alias(order), F.lit(0).alias("tp"), F.size("g").alias("n_gt")))
    return g.select(image, cls, F.explode(F.concat(hits, head)).alias("e")).select(image, cls, "e.*")


#: Detections of a class that one task of the running sums takes.
CHUNK = 1 << 16


def average_precision(assigned: DataFrame, cls: str, score: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """(class, ap, n_gt): area under the interpolated precision-recall curve, from running sums (A21). Classes without truth are left out.

    A class's detections are ranked without a window over all of them and cut into chunks; sums and maxima run within a chunk, and
    what comes before and after it is added from a table with a row a chunk.
    """
    assigned = checkpoint(assigned.select(cls, score, order, "tp", "n_gt"))  # read three times
    n_gt = assigned.groupBy(cls).agg(F.sum("n_gt").alias("total")).where("total > 0")
    found = assigned.where(F.col(score).isNotNull()).select(cls, (-F.col(score)).alias("__neg"), order, "tp")
    d = rank_within(found, cls, ["__neg", order], "__r").withColumn("__chunk", F.floor(F.col("__r") / chunk))
    own, all_before = Window.partitionBy(cls, "__chunk").orderBy("__r"), Window.partitionBy(cls).orderBy("__chunk")
    sums = d.groupBy(cls, "__chunk").agg(F.sum("tp").alias("__tp"))
    sums = sums.select(F.col(cls).alias("__c"), F.col("__chunk").alias("__k"), F.coalesce(F.sum("__tp").over(all_before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    same = lambda t, c, k: F.col(cls).eqNullSafe(F.col(c)) & (F.col("__chunk") == F.col(k))
    d = join_checked(d, sums, same(d, "__c", "__k"), "inner", 100).drop("__c", "__k")
    cum = F.col("__before") + F.sum("tp").over(own.rowsBetween(Window.unboundedPreceding, 0))
    d = checkpoint(d.withColumn("__precision", cum / (F.col("__r") + 1)).select(cls, "__chunk", "__r", "tp", "__precision"))
    tops = d.groupBy(cls, "__chunk").agg(F.max("__precision").alias("__top"))
    later = Window.partitionBy(cls).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col(cls).alias("__c"), F.col("__chunk").alias("__k"), F.max("__top").over(later).alias("__after"))
    # From the last row back: a frame that starts at the first row grows, one that ends at the last is computed anew for each row.
    back = Window.partitionBy(cls, "__chunk").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    d = join_checked(d, tops, same(d, "__c", "__k"), "inner", 100).withColumn("__best", F.greatest(F.max("__precision").over(back), "__after"))
    ap = d.where("tp = 1").groupBy(cls).agg(F.sum("__best").alias("area")).withColumnRenamed(cls, "__c")
    return n_gt.join(ap, F.col(cls).eqNullSafe(F.col("__c")), "left").select(cls, (F.coalesce("area", F.lit(0.0)) / F.col("total")).alias("ap"), F.col("total").alias("n_gt"))

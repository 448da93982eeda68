"""Work that costs much a row is spread by rows, not by bytes."""

import pytest

from vellumkit.plans.registry import QUERIES, Tables
from vellumkit.runtime import spread

BIG = "/root/testdata/sf0.1"  # 20,000 parts in one row group


def test_short_rows_are_many_tasks(spark):
    rows = spark.range(0, 10_000, 1, 1)
    assert spread(rows, 4096).rdd.getNumPartitions() == 3
    assert spread(rows, 10_000).rdd.getNumPartitions() == 1
    assert Tables(spark, BIG).part.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("name", ["json_repair_parse", "region_answers", "nested_polygons", "polygon_canonical"])
def test_a_query_is_more_than_a_task(spark, name):
    assert QUERIES[name](spark, BIG).rdd.getNumPartitions() > 1


def test_regions_send_only_rotated_boxes_to_python(spark):
    from pyspark.sql import functions as F

    from vellumkit.operators import regions as R

    d = spark.createDataFrame([(r, [0, 0, 4, 2], [4, 2, 0, 0, 0, 2, 4, 0]) for r in ("hbb", "obb", "polygon")], "r string, b array<int>, p array<int>")
    d = d.select("r", R.coords_of(F.col("r"), F.col("b"), F.col("p")).alias("c"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    call = plan[plan.index("min_area_rect(") :].split("#")[0]
    assert "CASE WHEN (r" in call
    assert {x["r"]: x["c"] for x in d.collect()} == {"hbb": [0, 0, 4, 2], "obb": [2, 1, 4, 2, 0], "polygon": [0, 0, 4, 0, 4, 2, 0, 2]}


def test_masks_are_counted_where_the_polygons_are(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from vellumkit.functions import geometry as G

    a, b = [[3.0, 250.0, 9.5, 250.0, 9.5, 300.0, 3.0, 300.0], [40.0, 7.0, 60.0, 20.0, 44.0, 31.0]], [[5.0, 240.0, 20.0, 240.0, 20.0, 254.0, 5.0, 254.0], [-30.0, -9.0, -4.0, -9.0, -4.0, -2.0]]
    window = (7, 3, 255, 60)
    assert (G.raster_np(a, 256, 256, window) == G.raster_np(a, 256, 256)[7:256, 3:61]).all()
    x, y = (G.raster_np(p, 256, 256).astype(bool) for p in (a, b))
    want = [int(np.sum(m)) for m in (~x & ~y, x & ~y, ~x & y, x & y)]
    out = [[300.0, 300.0, 310.0, 300.0, 310.0, 310.0]]
    d = spark.createDataFrame([(a, b), (out, b), (out, out), ([], []), (None, a)], "p array<array<double>>, t array<array<double>>")
    got = [list(r["c"]) for r in d.select(G.mask_counts(F.col("p"), F.col("t")).alias("c")).collect()]
    assert got[0] == want and got[1] == [256 * 256 - int(y.sum()), 0, int(y.sum()), 0] and got[2] == got[3] == [256 * 256, 0, 0, 0] and got[4] == [256 * 256 - int(x.sum()), 0, int(x.sum()), 0]


def test_corners_are_put_in_order_once(spark):
    from pyspark.sql import functions as F

    from vellumkit.functions import geometry as G

    p = F.split(F.col("id").cast("string"), ",").cast("array<double>")
    plan = spark.range(1).select(G.normalize_polygon(p).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("atan2") == 1 and plan.count("split(") == 1


def test_merged_patches_are_more_than_a_task(spark):
    from pyspark.sql import functions as F

    from vellumkit.sources import sinks as K

    k = F.col("id")
    poly = F.array(*[F.lit(v) for v in (0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0)])
    image = F.concat(F.lit("I"), F.floor(k / 2).cast("string"), F.lit("__1__0___0"))
    got = K.merge_patches(spark.range(0, 20_000, 1, 1).select(image.alias("image"), F.lit("a").alias("class_name"), (k % 7).cast("double").alias("score"), poly.alias("poly")))
    assert got.rdd.getNumPartitions() > 1 and got.count() == 10_000
    assert got.selectExpr("sum(score)").first()[0] == sum(max(j % 7, (j + 1) % 7) for j in range(0, 20_000, 2))


def test_boxes_of_line_items_are_spread(spark):
    assert QUERIES["box_text_rewrite"](spark, BIG).rdd.getNumPartitions() == 10


def test_pairs_as_rows_are_those_of_the_matrix(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from vellumkit.operators import detection as D

    rng = np.random.default_rng(7)

    def box():
        x, y, w, h = rng.integers(0, 9, 4).tolist()
        return [float(v) for v in (x, y, x + w, y + h)]

    rows = [(k, [box() for _ in range(rng.integers(1, 5))], [box() for _ in range(rng.integers(1, 5))]) for k in range(60)]
    d = spark.createDataFrame(rows, "k int, p array<array<double>>, g array<array<double>>")
    pairs = D.box_pairs(d, "p", "g")
    want = {(r["k"], r["i"], r["j"]): r["v"] for r in d.select("k", F.explode(D.pair_matrix(F.col("p"), F.col("g"))).alias("e")).select("k", "e.*").collect()}
    assert {(r["k"], r["i"], r["j"]): r["v"] for r in pairs.collect()} == pytest.approx(want, abs=1e-12)
    folds = {r["k"]: r["n"] for r in d.select("k", D.greedy_matches(D.pair_matrix(F.col("p"), F.col("g")), 0.2).alias("n")).collect()}
    matched = D.matched_boxes(pairs, ["k"], 0.2)
    assert {r["k"]: r["hits"] for r in matched.collect()} == folds and len(set(folds.values())) > 2
    assert matched._jdf.queryExecution().optimizedPlan().toString().count("greatest(") < 40  # not spelled out below a filter


def test_detections_are_assigned_once(spark):
    from pyspark.sql import functions as F

    from vellumkit.operators import detection as D

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def hit(k):
        seen.add(1)
        return int(k % 2)

    found = spark.range(0, 50, 1, 2).select(F.lit("c").alias("cls"), F.col("id").cast("double").alias("score"), F.col("id").alias("ord"), hit("id").alias("tp"), F.lit(1).alias("n_gt"))
    assert D.average_precision(found, "cls", "score", "ord").collect()[0]["n_gt"] == 50
    assert seen.value == 50


def test_grams_are_made_once(spark):
    from vellumkit.operators import metrics as M

    d = spark.createDataFrame([(1, "a b c d e", ["a b c d", "b c d e f"]), (2, "x y", ["x y z"])], "k int, p string, r array<string>")
    scores = M.cider(d, "k", "p", "r")
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # sides, grams
    assert scores.count() == 2


def test_a_task_reads_a_bounded_file_of_annotations(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    files = QUERIES["xml_object_scan"](spark, BIG).inputFiles()
    assert max(Path(urlparse(f).path).stat().st_size for f in files) < 32 << 20

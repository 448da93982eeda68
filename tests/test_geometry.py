import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vellumkit.functions import geometry as G


def box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def loop_iou(a, b):
    """Inclusive-pixel definition."""
    x1, y1, x2, y2 = max(a[0], b[0]), max(a[1], b[1]), min(a[2] - 1, b[2] - 1), min(a[3] - 1, b[3] - 1)
    inter = (x2 - x1 + 1) * (y2 - y1 + 1) if x1 < x2 and y1 < y2 else 0
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def test_iou_against_definition(spark):
    rng = np.random.default_rng(0)
    p = rng.integers(0, 12, (300, 4)).astype(float)
    p[:, 2:] = p[:, :2] + 1 + p[:, 2:] % 6
    pairs = [(p[i].tolist(), p[i + 1].tolist()) for i in range(0, 298)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>").select("a", "b", G.box_iou(F.col("a"), F.col("b")).alias("v"))
    for r in df.collect():
        assert r["v"] == pytest.approx(loop_iou(r["a"], r["b"]))
    assert one(spark, G.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) is None


def test_giou_forms_agree(spark):
    a, b = [0, 0, 10, 10], [5, 5, 20, 12]
    want = one(spark, G.box_giou(box(*a), box(*b)))
    assert G.polygon_giou_np(a, b) == pytest.approx(want)
    assert one(spark, G.polygon_giou(box(*a), box(*b))) == pytest.approx(want)
    assert G.polygon_giou_np([0, 0, 0, 0], b) == 0.0
    assert G.polygon_giou_np(a, a) == pytest.approx(1.0)


@given(st.lists(st.integers(0, 50), min_size=8, max_size=8))
@settings(max_examples=60, deadline=None)
def test_giou_at_most_iou(v):
    a, b = ([v[0], v[1], v[0] + v[2] + 1, v[1] + v[3] + 1], [v[4], v[5], v[4] + v[6] + 1, v[5] + v[7] + 1])
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    iou = w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)
    assert -1 <= G.polygon_giou_np(a, b) <= iou + 1e-9


def test_polygons(spark):
    p = box(10, 10, 0, 10, 0, 0, 10, 0)
    assert one(spark, G.normalize_polygon(p, clockwise=False)) == [0, 0, 0, 10, 10, 10, 10, 0]
    assert one(spark, G.normalize_polygon(p)) == [0, 0, 10, 0, 10, 10, 0, 10]
    assert one(spark, G.polygon_area(p)) == 100
    q = one(spark, G.rbox_to_qbox(box(5, 5, 4, 2, math.pi / 2)))
    assert q == pytest.approx([6, 3, 6, 7, 4, 7, 4, 3])
    assert one(spark, G.min_area_rect(box(0, 0, 10, 0, 10, 4, 0, 4))) == [5, 2, 10, 4, 0]


def test_rle_round_trip(spark):
    assert one(spark, G.rle_rows(F.array(F.array(*map(F.lit, (0, 1, 1))), F.array(*map(F.lit, (0, 0, 0)))))) == "0*1,1*2;0*3;"
    m = np.random.default_rng(1).integers(0, 2, (6, 20)).tolist()
    text = spark.createDataFrame([(m,)], "m array<array<int>>").select(G.rle_rows(F.col("m")).alias("c")).first()[0]
    back = [[int(v) for run in row.split(",") for v in [run.split("*")[0]] * int(run.split("*")[1])] for row in text.split(";")[:-1]]
    assert back == m


@pytest.mark.parametrize("h,w,want", [(100, 100, (112, 112)), (28, 28, (56, 56)), (70, 42, (56, 56)), (4000, 3000, None)])
def test_smart_resize(spark, h, w, want):
    r = one(spark, G.smart_resize(F.lit(float(h)), F.lit(float(w))))
    assert r["h"] % 28 == 0 and r["w"] % 28 == 0 and 56 * 56 <= r["h"] * r["w"] <= 14 * 14 * 4 * 1280
    assert want is None or tuple(r) == want


def test_coordinates(spark):
    assert one(spark, G.xywh_to_xyxy(box(1.5, 2, 3.9, 4))) == [1.5, 2, 5, 6]
    assert one(spark, G.resize_coords(box(10, 20, 30, 40), F.lit(100), F.lit(100), F.lit(50), F.lit(25))) == [5, 5, 15, 10]
    one_, two = F.lit(1.0), F.lit(2.0)
    assert one(spark, G.rescale_box(box(1, 2, 3, 4), one_, two, two, one_)) == [2, 1, 6, 2]


def test_masks(spark):
    m = G.raster_np([[1, 1, 4, 1, 4, 3, 1, 3]], 8, 8)
    assert m.sum() == 12 == one(spark, G.box_pixels(box(1, 1, 4, 3), 8, 8))
    df = spark.createDataFrame([([[1.0, 1.0, 4.0, 1.0, 4.0, 3.0, 1.0, 3.0]], [[1.0, 1.0, 4.0, 1.0, 4.0, 2.0, 1.0, 2.0]])], "p array<array<double>>, t array<array<double>>")
    r = df.select(G.mask_counts(F.col("p"), F.col("t"), 8, 8).alias("c")).first()["c"]
    assert (r["tp"], r["fp"], r["fn"]) == (8, 4, 0) and r["tn"] == 52
    ring = np.ones((9, 9), int)
    ring[3:6, 3:6] = 0
    assert G.close_mask_np(ring, 2).all()
    assert G.max_pool_np(np.eye(5, dtype=int), 2).tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_runs_of_masks():
    import numpy as np

    from vellumkit.functions import geometry as G

    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (7, 2)):
        for p in (0.0, 0.3, 1.0):
            m = (rng.random((h, w)) < p).astype(np.uint8)
            runs = G.mask_runs_np(m)
            assert sum(runs) == h * w and (G.runs_mask_np(runs, h, w) == m).all() and all(r > 0 for r in runs[1:])
    assert G.mask_runs_np(np.array([[0, 1], [1, 1]])) == [1, 3]

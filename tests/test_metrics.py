import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumkit.operators import detection as D, metrics as M


def test_empty_is_null(spark):
    df = spark.createDataFrame([], "p string, g string")
    assert df.agg(M.accuracy(M.identical(F.col("p"), F.col("g"))).alias("a")).first()["a"] is None


def test_zero_correct_task(spark):
    df = spark.createDataFrame([("t", "a", "b")], "task string, p string, g string")
    assert [(r["task"], r["accuracy"]) for r in M.task_accuracy(df, "task", "p", "g").collect()] == [("t", 0.0)]


def test_confusion_scores(spark):
    rng = np.random.default_rng(0)
    gt, pred = rng.integers(0, 4, 500), rng.integers(0, 4, 500)
    pred[:250] = gt[:250]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(gt, pred)] + [(9, 0), (-1, 1)], "g int, p int")
    m = np.zeros((4, 4))
    np.add.at(m, (gt, pred), 1)
    d, r, c, n = np.diag(m), m.sum(1), m.sum(0), m.sum()
    got = M.confusion_scores(M.confusion(df, "g", "p", 4), 4).first()
    pe = (r * c).sum() / n**2
    assert got["oa"] == pytest.approx(d.sum() / n)
    assert got["miou"] == pytest.approx((d / (r + c - d)).mean(), abs=1e-6)
    assert got["kappa"] == pytest.approx((d.sum() / n - pe) / (1 - pe))
    assert got["fwiou"] == pytest.approx((r / n * d / (r + c - d)).sum())


def area_loop(rows, classes):
    s = {c: dict(tp=0.0, fp=0.0, fn=0.0, n=0.0) for c in classes}
    for g, p, a in rows:
        if p in classes:
            if p == g:
                s[p]["tp"] += a
            else:
                s[p]["fp"] += a
                s[g]["fn"] += a
        s[g]["n"] += a
    f1 = {}
    for c, x in s.items():
        pr = x["tp"] / (x["tp"] + x["fp"]) if x["tp"] + x["fp"] else 0
        re = x["tp"] / (x["tp"] + x["fn"]) if x["tp"] + x["fn"] else 0
        f1[c] = 2 * pr * re / (pr + re) if pr + re else 0
    total = sum(x["n"] for x in s.values())
    w = {c: s[c]["n"] / total for c in classes}
    inv = {c: 1 / v for c, v in w.items() if v}
    return sum(f1.values()) / len(f1), sum(f1[c] * w[c] for c in classes), sum(f1[c] * v for c, v in inv.items()) / sum(inv.values())


def test_area_weighted_f1(spark):
    rng = np.random.default_rng(3)
    classes = ["a", "b", "c", "d"]
    rows = [(classes[i], (classes + ["zz"])[j], float(a)) for i, j, a in zip(rng.integers(0, 3, 60), rng.integers(0, 5, 60), rng.integers(1, 9, 60))]
    got = M.area_weighted_f1(spark.createDataFrame(rows, "g string, p string, a double"), "g", "p", "a", classes).first()
    assert tuple(got) == pytest.approx(area_loop(rows, classes))


def test_mae(spark):
    df = spark.createDataFrame([("x", [2.0, 0.0, 9.0], [1.5, 4.0])], "k string, g array<double>, p array<double>")
    r = M.mae_mape(df, F.col("g"), F.col("p"), ["k"]).first()
    assert (r["mae"], r["mape"], r["n"]) == (2.25, 0.25, 2)  # the zero truth has no relative error; the third has no partner


def test_captions(spark):
    same = spark.createDataFrame([(1, "a b c d e", ["a b c d e"]), (2, "v w x y z", ["v w x y z", "v w x y"])], "k int, p string, r array<string>")
    assert M.bleu4(same, "k", "p", "r").first()[0] == pytest.approx(1.0)
    scores = {r["k"]: r["cider"] for r in M.cider(same, "k", "p", "r").collect()}
    assert scores[1] == pytest.approx(10.0) and 5 < scores[2] < 10
    other = spark.createDataFrame([(1, "q", ["a b c d e"]), (2, "v w x y z", ["m"])], "k int, p string, r array<string>")
    assert M.bleu4(other, "k", "p", "r").first()[0] == 0.0
    assert all(r["cider"] == 0 for r in M.cider(other, "k", "p", "r").collect())


def test_greedy_fold_is_the_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(40):
        p, g = ([[float(x), float(y), float(x + w), float(y + h)] for x, y, w, h in zip(*rng.integers(0, 8, (2, n)), *rng.integers(3, 9, (2, n)))] for n in (int(rng.integers(0, 5)), int(rng.integers(1, 5))))
        rows.append((k, p, g))
        v = spark_free_giou(p, g)
        want.append(len(D.greedy_matches_np(v, 0.3)))
    df = spark.createDataFrame(rows, "k int, p array<array<double>>, g array<array<double>>")
    got = df.select("k", D.greedy_matches(D.pair_matrix(F.col("p"), F.col("g")), 0.3).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == want
    assert {r["k"]: r["tp"] for r in D.polygon_matches(df, "k", "p", "g", 0.3).collect()} == dict(enumerate(want))


def spark_free_giou(p, g):
    from vellumkit.functions.geometry import polygon_giou_np

    return np.array([[polygon_giou_np(a, b) for b in g] for a in p]).reshape(len(p), len(g))


def ap_by_hand(rows, iou):
    """The usual loop over detections by score; rows: (image, class, score or None, ord, box, kind)."""
    out = {}
    for c in {r[1] for r in rows if r[5] == "gt"}:
        free = {(r[0], r[3]): r[4] for r in rows if r[1] == c and r[5] == "gt"}
        total, taken, tp = len(free), set(), []
        for im, _, s, o, b, _ in sorted((r for r in rows if r[1] == c and r[5] == "pred"), key=lambda r: (-r[2], r[3])):
            own = [(iou(b, g), -k) for k, ((i, _), g) in enumerate(sorted(free.items())) if i == im]
            best = max(own, default=(0, 0))
            tp.append(best[0] >= 0.5 and (im, best[1]) not in taken)
            if tp[-1]:
                taken.add((im, best[1]))
        cum = [sum(tp[: k + 1]) / (k + 1) for k in range(len(tp))]
        out[c] = sum(max(cum[k:]) for k in range(len(tp)) if tp[k]) / total
    return out


@pytest.mark.parametrize("quads", [False, True])
@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_average_precision_against_a_loop(spark, quads, chunk):
    from vellumkit.functions.geometry import polygon_iou_np

    rng = np.random.default_rng(4)
    rows = []
    for k in range(240):
        x, y, w, h, d = (float(v) for v in rng.integers(0, 30, 5))
        box = [x, y, x + w + 5, y + h + 5] if not quads else [x + d, y, x + 30, y + d, x + 30 - d, y + 30, x, y + 30 - d]
        kind = "gt" if k % 3 == 0 else "pred"
        rows.append((int(rng.integers(0, 8)), "ab"[k % 2], None if kind == "gt" else float(rng.integers(0, 5)), k, box, kind))
    df = spark.createDataFrame(rows, "image long, cls string, score double, ord long, box array<double>, kind string")
    got = {r["cls"]: r["ap"] for r in D.average_precision(D.assign_detections(df, "image", "cls", "score", "ord"), "cls", "score", "ord", chunk).collect()}
    assert got == pytest.approx(ap_by_hand(rows, polygon_iou_np)) and len(got) == 2


def test_average_precision(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    far = [50.0, 50.0, 60.0, 60.0]
    rows = [("i", "c", None, 1, box, "gt"), ("i", "c", None, 2, far, "gt"), ("i", "c", 0.9, 3, box, "pred"), ("i", "c", 0.8, 4, box, "pred"), ("i", "c", 0.7, 5, far, "pred"), ("j", "d", 0.5, 6, box, "pred")]
    df = spark.createDataFrame(rows, "image string, cls string, score double, ord bigint, box array<double>, kind string")
    got = D.average_precision(D.assign_detections(df, "image", "cls", "score", "ord"), "cls", "score", "ord").collect()
    assert [(r["cls"], r["n_gt"]) for r in got] == [("c", 2)]
    assert got[0]["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_referring_without_prediction(spark):
    df = spark.createDataFrame([(None, [[0.0, 0.0, 1.0, 1.0]]), ([], [[0.0, 0.0, 1.0, 1.0]]), ([[0.0, 0.0, 1.0, 1.0]], [[0.0, 0.0, 1.0, 1.0]])], "p array<array<double>>, g array<array<double>>")
    assert [r[0] for r in df.select(D.referring_ok(F.col("p"), F.col("g"))).collect()] == [False, False, True]

import pytest
from pyspark.sql import functions as F

from vellumkit.operators import benchmarks as B


def scores(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_names():
    assert B.check_benchmark("cls_aid_unique_4") == ("cls_aid", 4, True) and B.check_benchmark("lrsvqa") == ("lrsvqa", 0, False)
    assert B.geoground_name("geoground_dior_rsvg_val_336") == ("dior_rsvg_val", 336) and B.geoground_name("geoground_rsvg_test") == ("rsvg_test", None)
    assert B.family("cap_rsicd")[0] == "caption"
    with pytest.raises(ValueError):
        B.family("nothing")


def test_prompts(spark):
    df = spark.createDataFrame([("i.png", "big ship", "a,b.")], "image_id string, normal_caption string, classes string")
    m = B.prepare(df, "refcoco_val", "/r", prompt_type="json").first()["message"]
    assert len(m) == 1 and m[0]["content"][0]["media"] == "file:///r/i.png" and "big ship" in m[0]["content"][1]["text"]
    m = B.prepare(df, "cls_aid_4", "/r", prefix=F.array(B._message("user", F.lit("shot")))).first()["message"]
    assert len(m) == 2 and m[1]["content"][1]["text"].endswith(":a,b.")
    with pytest.raises(ValueError):
        B.prepare(df, "refcoco_val", "/r", prompt_type="odd")


def test_rec(spark):
    rows = [("[10, 10, 30, 30]", [20.0, 20.0, 60.0, 60.0], [20.0, 20.0, 60.0, 60.0]), ("[0.01, 0.01, 0.03, 0.03]", [0.0] * 4, [20.0, 20.0, 60.0, 60.0]), ("none", [20.0, 20.0, 60.0, 60.0], [0.0] * 4)]
    df = spark.createDataFrame(rows, "output string, solution array<double>, normalized_solution array<double>").withColumns({"original_width": F.lit(200), "original_height": F.lit(200), "resized_width": F.lit(100), "resized_height": F.lit(100), "dataset_name": F.lit("d")})
    assert scores(B.evaluate(df, "refcoco_val")) == {"acc@0.5": pytest.approx(200 / 3)}
    assert list(scores(B.evaluate(df, "geoground_all"))) == ["d_acc@0.5"]


def test_synonyms(spark):
    df = spark.createDataFrame([("FAIR_1", "count", "Auto.", "car"), ("STAR_2", "reasoning", "boat", "car"), ("STAR_3", "count", "x", "X.")], "question_id string, category string, output string, ground_truth string")
    syn = spark.createDataFrame([("car", 1), ("auto", 1), ("boat", 2)], "lemma string, synset int")
    got = scores(B.lrsvqa_scores(df, syn))
    assert got["overall"] == pytest.approx(2 / 3) and got["task_count"] == 1.0 and got["average"] == 0.5 and got["average_source_STAR"] == 0.5
    assert scores(B.lrsvqa_scores(df))["overall"] == pytest.approx(1 / 3)


def quad_rows(spark, points, prompt):
    """Rotated squares: a perfect answer, one that is off by half, one in another order of the corners, and one too many."""
    square = [[10.0, 0.0], [20.0, 10.0], [10.0, 20.0], [0.0, 10.0]]
    flat = lambda q: [int(v) for p in q for v in p]
    off, turned, far = [[x + 5, y + 5] for x, y in square], [square[k] for k in (2, 0, 3, 1)], [[x + 100, y] for x, y in square]
    form = (lambda qs: "```json\n[" + ",".join(f'{{"bbox_2d": {flat(q)}, "label": "a"}}' for q in qs) + "]\n```") if prompt == "json" else (lambda qs: "\n".join(f"{','.join(map(str, flat(q)))} a" for q in qs))
    truth = lambda qs: qs if points else [[v for p in q for v in p] for q in qs]
    rows = [(form(p), truth(g), ["o"] * len(g), "small", "rec") for p, g in (([square], [square]), ([off], [square]), ([turned], [square]), ([square, far], [square]), ([far, turned], [square, far]), ([], [square]))]
    kind = "array<array<array<double>>>" if points else "array<array<double>>"
    return spark.createDataFrame(rows, f"output string, ground_truth {kind}, obj_ids array<string>, size_group string, type string").withColumns({c: F.lit(10) for c in ("original_width", "original_height", "resized_width", "resized_height")})


@pytest.mark.parametrize("points,prompt", [(False, "json"), (True, "json"), (False, "plain"), (True, "plain")])
def test_referring_of_quadrangles(spark, points, prompt):
    got = scores(B.evaluate(quad_rows(spark, points, prompt), "geochat_referring", prompt_type=prompt))
    assert got["overall"] == pytest.approx(3 / 6) and got["count_single"] == pytest.approx(2 / 5) and got["count_multiple"] == 1.0


def test_a_perfect_answer_of_corners_counts(spark):
    df = spark.createDataFrame([("0,0,10,0,10,10,0,10", [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]], ["o"], None, None)], "output string, ground_truth array<array<double>>, obj_ids array<string>, size_group string, type string").withColumns({c: F.lit(10) for c in ("original_width", "original_height", "resized_width", "resized_height")})
    assert scores(B.evaluate(df, "geochat_referring", prompt_type="plain"))["overall"] == 1.0


def test_detection_by_rotated_overlap(spark):
    """Of the second image the bounds overlap by 0.64, the quadrangles by 0.32."""
    diamond, bounds = [10, 0, 20, 10, 10, 20, 0, 10], [0, 0, 20, 0, 20, 20, 0, 20]
    line = lambda p: f"{','.join(map(str, p))} ship"
    truth = lambda p: [{"poly": [float(v) for v in p], "label": "ship"}]
    df = spark.createDataFrame([("a", line(diamond), truth(diamond)), ("b", line(bounds), truth([10, 2, 18, 10, 10, 18, 2, 10]))], "file_name string, output string, gt array<struct<poly: array<double>, label: string>>").withColumns({c: F.lit(10) for c in ("original_width", "original_height", "resized_width", "resized_height")})
    got = scores(B.evaluate(df, "dota_val", classes=["ship", "plane"], prompt_type="plain"))
    assert got["ship_ap"] == pytest.approx(0.5)  # one of two found, at full precision


def test_referring(spark):
    gt = [[0.0, 0.0, 10.0, 10.0]]  # both sides are scaled
    rows = [('```json\n[{"bbox_2d": [0, 0, 10, 10], "label": "a"}]\n```', gt, ["o"], "small", "rec"), ("junk", gt, ["o"], "small", "rec"), ('[{"bbox_2d": [0, 0, 10, 10]}]', gt * 2, ["o", "p"], None, "rec")]
    df = spark.createDataFrame(rows, "output string, ground_truth array<array<double>>, obj_ids array<string>, size_group string, type string").withColumns({c: F.lit(v) for c, v in (("original_width", 20), ("original_height", 20), ("resized_width", 10), ("resized_height", 10))})
    got = scores(B.referring_scores(df))
    assert got["overall"] == pytest.approx(1 / 3) and got["count_single"] == 0.5 and got["size_unknown"] == 0 and got["size_small"] == 0.5


def test_masks(spark):
    df = spark.createDataFrame([("[0, 0, 50, 50]", "[1]", "POLYGON ((0 0, 0 128, 128 128, 128 0, 0 0))"), ("none", "no", None)], "output string, ground_truth string, polygon string").withColumns({"dataset": F.lit("s2_det"), "task": F.lit("change_detection_detection")})
    assert scores(B.teochatlas_scores(df)) == {"s2_det_change_detection_detection_f1": 1.0}
    assert df.select(B.wkt_rings(F.lit("MULTIPOLYGON (((0 0, 1.5 -2e1, 3 3)), ((1 1, 2 2, 3 3), (9 9, 8 8, 7 7)))")).alias("r")).first()["r"] == [[0, 0, 1.5, -20, 3, 3], [1, 1, 2, 2, 3, 3]]
    with pytest.raises(ValueError):
        B.teochatlas_scores(df.withColumn("dataset", F.lit("odd")))


def test_vhm_edges(spark):
    df = spark.createDataFrame([("counting_x", "none at all", "3"), ("counting_x", "five", "0"), ("gsd_x", "1 and 2", "4")], "image_path string, output string, ground_truth string")
    got = {r["metric"]: (r["value"], r["n"]) for r in B.vhm_scores(df).collect()}
    assert got == {"counting_mae": (5.0, 1), "counting_mape": (None, 0), "resolution_mae": (3.0, 1), "resolution_mape": (0.75, 1)}
    with pytest.raises(Exception, match="Unknown folder"):
        B.vhm_scores(df.withColumn("image_path", F.lit("odd"))).collect()


def test_detection(spark):
    inst = "array<struct<poly: array<int>, label: string>>"
    q = [0, 0, 10, 0, 10, 10, 0, 10]
    rows = [("f", '[{"quadrant bbox": [0,0,5,0,5,5,0,5], "label": "shp"}]', [(q, "ship")]), ("g", '[{"quadrant bbox": [0,0,5,0,5,5,0,5], "label": "ship"}]', []), ("h", "junk", [(q, "car")])]
    df = spark.createDataFrame(rows, f"file_name string, output string, gt {inst}").withColumns({c: F.lit(v) for c, v in (("original_width", 10), ("original_height", 10), ("resized_width", 5), ("resized_height", 5))})
    assert scores(B.detection_scores(df, ["ship", "car"])) == {"ship_ap": 1.0, "car_ap": 0.0, "mAP": 0.5}
    assert scores(B.detection_scores(df, ["ship", "car"], clear_for_empty=True))["ship_ap"] == 1.0


def test_formatters(spark):
    imgs = spark.createDataFrame([("a.png", [(" one ",), ("two",)], "train")], "filename string, sentences array<struct<raw: string>>, split string")
    assert B.format_captions(imgs, "d").first()["ground_truth"] == ["one", "two"]
    raw = spark.createDataFrame([("port", {"filename": "a.png", "raw": "x ", "raw_1": "y", "split": "val"})], "category string, item map<string, string>")
    r = B.format_raw_captions(raw, "d").first()
    assert (r["image_id"], sorted(r["ground_truth"]), r["split"]) == ("port/a.png", ["x", "y"], "val")
    cls = spark.createDataFrame([("b/1.png", "test"), ("a/2.png", "test")], "image_id string, split string")
    assert {x["ground_truth"]: x["classes"] for x in B.format_classes(cls, "d").collect()} == {"a": "a,b.", "b": "a,b."}
    g = spark.createDataFrame([("x.tif", "Q Classes: A, B\nmore", "MediumResidentialgt", 0)], "image string, text string, ground_truth string, question_id int")
    r = B.format_geochat(g, "cls", ".jpg").first()
    assert (r["image_id"], r["classes"], r["ground_truth"]) == ("x.jpg", "a, b", "medium residential")
    with pytest.raises(ValueError):
        B.format_geochat(g, "odd")

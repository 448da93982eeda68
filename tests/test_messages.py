import pytest
from pyspark.sql import functions as F

from vellumkit.operators import messages as S, model

CONV = "array<struct<from: string, value: string>>"


def frame(spark, turns, images=("a.png", "b.png"), videos=("v.mp4",)):
    return spark.createDataFrame([(turns, list(images), list(videos))], f"c {CONV}, i array<string>, v array<string>")


def test_messages(spark):
    df = frame(spark, [("human", "<image>\nWhat is\n<video>\nhere? <image> "), ("gpt", "A dog")])
    m = df.select(S.to_messages(F.col("c"), F.col("i"), F.col("v")).alias("m")).first()["m"]
    assert [x["role"] for x in m] == ["user", "assistant"]
    assert [(p["type"], p["media"]) for p in m[0]["content"]] == [("image", "a.png"), ("text", None), ("video", "v.mp4"), ("text", None), ("image", "b.png")]
    assert m[1]["content"][0]["text"] == "A dog"
    with pytest.raises(Exception, match="Invalid role"):
        frame(spark, [("robot", "x")]).select(S.to_messages(F.col("c"), F.col("i"), F.col("v"))).collect()


def test_tags_and_roles(spark):
    df = frame(spark, [(None, "hi"), ("gpt", "ho")])
    fixed = df.select(S.repair_roles(F.col("c")).alias("c"))
    assert [r["from"] for r in fixed.first()["c"]] == ["human", "gpt"]
    assert fixed.select(S.ensure_image_tag(F.col("c"), F.lit(True)).alias("c")).first()["c"][0]["value"] == "<image>\nhi"
    assert fixed.select(S.ensure_image_tag(F.col("c"), F.lit(False)).alias("c")).first()["c"][0]["value"] == "hi"


def test_answers(spark):
    anns = "array<struct<rank: int, name: string, bbox: array<int>>>"
    df = spark.createDataFrame([([(1, "car", [5, 5, 6, 6]), (0, "ship", [9, 2, 3, 4]), (0, "ship", [1, 2, 3, 4])],), ([],)], f"a {anns}")
    plain = [r[0] for r in df.select(S.detection_answer(F.col("a"), as_json=False)).collect()]
    assert plain == ["1,2,3,4 ship\n9,2,3,4 ship\n5,5,6,6 car\n", "There are none."]
    assert df.select(S.detection_answer(F.col("a"))).first()[0].startswith('```json\n[\n\t{"bbox_2d": [1, 2, 3, 4], "label": "ship"},')


def test_zoom_turns(spark):
    df = spark.createDataFrame([("q", "a", [[1.0, 2.0, 3.9, 4.0]]), ("q", "a", [[1.0] * 4] * 2)], "q string, a string, c array<array<double>>")
    n = df.select(S.zoom_conversation(F.col("q"), F.col("a"), F.col("c")).alias("m")).collect()
    assert [len(r["m"]) for r in n] == [5, 2] and "[1, 2, 3, 4]" in n[0]["m"][2]["text"]


def test_coco(spark):
    images = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 10, 10)], "id bigint, file_name string, width int, height int")
    anns = spark.createDataFrame([(7, 1, 5, [1.0, 2.0, 3.9, 4.0])], "id bigint, image_id bigint, category_id int, bbox array<double>")
    cats = spark.createDataFrame([(5, "Storage-Tank"), (6, "airplane")], "id int, name string")
    got = {r["id"]: r for r in S.coco_images(images, anns, cats).collect()}
    assert got[2]["annotations"] == [] and got[1]["categories"] == "airplane, storage tank"
    a = got[1]["annotations"][0]
    assert (a["rank"], a["name"], a["bbox"]) == (1, "storage tank", [1, 2, 4, 6])
    assert S.coco_images(images, anns, cats, keep_empty=False).count() == 1


def test_labels_and_splits(spark):
    df = spark.createDataFrame([("ship",), ("shp",), ("zzzz",)], "l string")
    got = [r["matched"] for r in S.fuzzy_labels(df, "l", ["ship", "car"]).orderBy("l").collect()]
    assert got[:2] == ["ship", "ship"] and got[2] in ("car", "ship")
    refs = spark.createDataFrame([("testA",), ("testAB",), ("testB",), ("val",), ("train",)], "split string")
    assert [S.refer_filter(refs, s).count() for s in ("testA", "testB", "test", "val")] == [2, 2, 3, 1]


def test_templates(spark):
    df = spark.range(300).select(S.choose_template(["a", "b", "c"], "id").alias("t"))
    assert {r["t"] for r in df.groupBy("t").count().where("count > 50").collect()} == {"a", "b", "c"}


def test_zoom_loop_is_bounded(spark):
    df = spark.createDataFrame([(1, "never ends"), (2, "done")], "id int, prompt string")
    factory = lambda: lambda b: b["prompt"].map(lambda p: "ok" if p == "done" else '<tool_call>{"arguments": {"bbox_2d": [1, 2, 3, 4]}}</tool_call>')
    got = {r["id"]: (r["rounds"], r["output"][:3]) for r in model.zoom_loop(df, factory, 3).collect()}
    assert got == {1: (3, "<to"), 2: (1, "ok")}
    assert model.infer(df, "echo").where("output is null").count() == 0

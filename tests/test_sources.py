import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from vellumkit.sources import readers as R, sinks as K

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 5)
JPG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 5, 7) + b"\x00" * 6


def test_json_or_jsonl(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 3}\nbroken\n')
    assert [r["x"] for r in R.read_json_or_jsonl(spark, str(tmp_path / "a.json"), "x int").orderBy("x").collect()] == [1, 2]
    df = R.read_json_or_jsonl(spark, str(tmp_path / "b.jsonl"), "x int, _corrupt_record string").cache()
    good, bad = K.split_bad_records(df, F.col("_corrupt_record").isNull())
    assert good.count() == 1 and bad.first()["_corrupt_record"] == "broken"
    with pytest.raises(ValueError):
        R.read_json_or_jsonl(spark, "c.txt")


def test_coco_and_dota(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png", "width": 3, "height": 4}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [0.0, 0.0, 1.0, 1.0]}], "categories": [{"id": 2, "name": "x"}]}))
    assert [d.count() for d in R.read_coco(spark, str(tmp_path / "c.json"))] == [1, 1, 1]
    (tmp_path / "P1.txt").write_text("imagesource:x\ngsd:1\n1 2 3 4 5 6 7 8 large-vehicle 1\n1 2 3 4 5 6 7 8 ship\n")
    got = R.read_dota(spark, str(tmp_path / "P1.txt")).orderBy("class_name").collect()
    assert [(r["file_name"], r["class_name"], r["difficult"]) for r in got] == [("P1", "large vehicle", 1), ("P1", "ship", 0)]


def test_xml_one_or_many(spark, tmp_path):
    obj = "<object><name>n{}</name></object>"
    for k, n in enumerate((1, 2)):
        (tmp_path / f"{k}.xml").write_text(f"<annotation><filename>f{k}</filename><split>{'test' if k else 'train'}</split>{''.join(obj.format(i) for i in range(n))}</annotation>")
    assert R.read_xml_objects(spark, str(tmp_path)).count() == 3
    assert R.read_xml_objects(spark, str(tmp_path), "test").count() == 2


def test_images(spark, tmp_path):
    for c, name in (("beach", "1.png"), ("airport", "2.JPG"), ("airport", "x.txt")):
        (tmp_path / c).mkdir(exist_ok=True)
        (tmp_path / c / name).write_bytes(PNG if name.endswith("png") else JPG)
    df = R.read_image_folder(spark, str(tmp_path), with_content=True)
    got = df.select("class_name", "class_id", R.image_size("content").alias("s"), R.media_kind(F.col("content")).alias("k")).orderBy("class_id").collect()
    assert [(r["class_name"], r["class_id"], r["s"]["width"], r["s"]["height"], r["k"]) for r in got] == [("airport", 0, 7, 5, "image"), ("beach", 1, 7, 5, "image")]
    assert R.image_size_of(b"junk") is None
    urls = spark.createDataFrame([("http://h/a.png",), ("file:///d/a.png",), ("data:image/png;base64," + base64.b64encode(PNG).decode(),)], "u string")
    src = [r["s"] for r in urls.select(R.media_source(F.col("u")).alias("s")).collect()]
    assert [s["scheme"] for s in src] == ["http", "file", "inline"] and src[1]["path"] == "/d/a.png" and bytes(src[2]["content"]) == PNG


def test_arrow(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.ipc.new_file(str(tmp_path / "f.arrow"), t.schema) as w:
        w.write_table(t)
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), t.schema) as w:
        w.write_table(t)
    assert R.read_arrow(spark, [str(tmp_path / "f.arrow"), str(tmp_path / "s.arrow")]).count() == 4


def test_catalog(spark, tmp_path):
    for given in ([{"name": "a", "annotation_path": "p"}, {"annotation_path": "q"}], {"a": [{"annotation_path": "p"}, {"annotation_path": "q"}]}):
        (tmp_path / "c.json").write_text(json.dumps(given))
        assert [r["annotation_path"] for r in R.read_catalog(spark, str(tmp_path / "c.json")).collect()] == ["p", "q"]
    assert R.custom_datasets(spark, ["a"], ["b"]).count() == 1
    with pytest.raises(ValueError):
        R.custom_datasets(spark, ["a"], [])
    for n in ("checkpoint-9", "checkpoint-10", "checkpoint-x"):
        (tmp_path / n).mkdir()
    assert R.latest_checkpoint(str(tmp_path)).endswith("checkpoint-10")
    assert R.pixel_limits({"min_pixels": 1, "max_pixels": 2}, max_pixels=9) == (1, 9)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    K.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 1
    with pytest.raises(Exception, match="unknown split"):
        K.write_splits(df.withColumn("split", F.lit("odd")), str(tmp_path / "t"))
    K.write_metrics(spark.createDataFrame([(0.5, 3)], "acc double, n int"), str(tmp_path / "m"), "b")
    assert {(r["metric"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("acc", 0.5), ("n", 3.0)}
    K.write_packed(spark.createDataFrame([(0, 0, [(1, 5)], 5)], R.PACKED), str(tmp_path / "p"))
    assert spark.read.schema(R.PACKED).json(str(tmp_path / "p")).first()["members"][0]["id"] == 1
    K.write_arrays(spark.createDataFrame([([1, 2], [0, 1])], "i array<bigint>, f array<bigint>"), str(tmp_path / "a"), ("i",), ("f",))
    assert dict(spark.read.parquet(str(tmp_path / "a")).dtypes) == {"i": "array<int>", "f": "array<smallint>"}
    det = spark.createDataFrame([("P1", "ship", 0.5, [1.0] * 8)], "image string, class_name string, score double, poly array<double>")
    K.write_submission(det, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()["value"].startswith("P1 0.5000 1.00 1.00")
    K.write_results(spark.createDataFrame([(1, bytearray(b"x"))], "id int, content binary"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["id"]
    todo = spark.createDataFrame([("a",), ("b",)], "benchmark string")
    assert K.pending(todo, spark, str(tmp_path / "done")).count() == 2
    K.mark_done(spark, str(tmp_path / "done"), "a")
    assert [r["benchmark"] for r in K.pending(todo, spark, str(tmp_path / "done")).collect()] == ["b"]


def test_patches_are_merged(spark):
    square = lambda x, y: [x, y, x + 20.0, y, x + 20.0, y + 20.0, x, y + 20.0]
    rows = [("I__2.0__100___40", "ship", 0.5, square(10.0, 0.0)), ("I__2.0__0___0", "ship", 0.9, square(112.0, 40.0)), ("I__2.0__0___0", "plane", 0.1, square(110.0, 40.0)), ("plain", "ship", 0.3, square(1.0, 2.0))]
    got = K.merge_patches(spark.createDataFrame(rows, "image string, class_name string, score double, poly array<double>")).collect()
    assert sorted((r["image"], r["class_name"], r["score"], r["poly"][0], r["poly"][1]) for r in got) == [("I", "plane", 0.1, 55.0, 20.0), ("I", "ship", 0.9, 56.0, 20.0), ("plain", "ship", 0.3, 1.0, 2.0)]


def test_catalog_of_names_and_yaml(spark, tmp_path):
    text = "a: {annotation_path: p}\nb: [a, {annotation_path: q}]\nc: b\n"
    (tmp_path / "c.yaml").write_text(text)
    yaml = pytest.importorskip("yaml")
    want = [("a", "p"), ("b", "p"), ("b", "q"), ("c", "p"), ("c", "q")]
    (tmp_path / "c.json").write_text(json.dumps(yaml.safe_load(text)))
    for name in ("c.yaml", "c.json"):
        assert [(r["name"], r["annotation_path"]) for r in R.read_catalog(spark, str(tmp_path / name)).collect()] == want
    (tmp_path / "d.json").write_text('{"a": "b", "b": "a"}')
    with pytest.raises(ValueError):
        R.read_catalog(spark, str(tmp_path / "d.json"))


def test_rotated_boxes_of_xml(spark, tmp_path):
    corners = "".join(f"<{a}{k}>{v}</{a}{k}>" for k, p in (("_left_top", (0, 1)), ("_right_top", (4, 1)), ("_right_bottom", (4, 3)), ("_left_bottom", (0, 3))) for a, v in zip("xy", p))
    objects = f"<object><name>Ship</name><robndbox><cx>10</cx><cy>5</cy><w>4</w><h>2</h><angle>90</angle></robndbox></object><object><name>dam</name><polygon>{corners}</polygon></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.png</filename>{objects}</annotation>")
    got = {r["class_name"]: (r["file_name"], [round(v, 6) for v in r["poly"]]) for r in R.read_rotated_boxes(spark, str(tmp_path)).collect()}
    assert got == {"ship": ("a", [11.0, 3.0, 11.0, 7.0, 9.0, 7.0, 9.0, 3.0]), "dam": ("a", [0.0, 1.0, 4.0, 1.0, 4.0, 3.0, 0.0, 3.0])}

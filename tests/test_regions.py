from pyspark.sql import functions as F

from vellumkit.operators import benchmarks as B, regions as R


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_samples(spark):
    df = spark.createDataFrame([(0, "a", True), (1, "b", False)], "idx int, image_id string, mask_exists boolean")
    assert R.samples(df, "idx", "refgeo").count() == 7 and R.samples(df, "idx", "dense_det").count() == 6
    masks = spark.createDataFrame([("b",), ("b",)], "image_id string")
    got = R.samples(df, "idx", "refgeo", masks).where("region_type = 'seg'").collect()
    assert [r["image_id"] for r in got] == ["b"]


def test_answers(spark):
    df = spark.createDataFrame([("hbb",), ("obb",), ("polygon",)], "r string")
    poly, box = F.array(*map(F.lit, (10, 4, 0, 4, 0, 0, 10, 0))), F.array(*map(F.lit, (0, 0, 10, 4)))
    c = df.withColumn("c", R.coords_of(F.col("r"), box, poly))
    assert [r["c"] for r in c.collect()] == [[0, 0, 10, 4], [5, 2, 10, 4, 0], [0, 0, 10, 0, 10, 4, 0, 4]]
    plain = c.select(R.region_answer(F.col("r"), F.col("c"), F.lit("ship"), F.lit(False)).alias("a")).first()["a"]
    assert plain == "0,0,10,4 ship\n"
    js = [r["a"] for r in c.select(R.region_answer(F.col("r"), F.col("c"), F.lit("ship"), F.lit(True)).alias("a")).collect()]
    assert '"bbox_2d": [0, 0, 10, 4]' in js[0] and '"quadrant bbox"' in js[2]


def test_mask_answer(spark):
    m = [[2 if 2 <= x < 6 and 2 <= y < 6 else 0 for x in range(8)] for y in range(8)]
    df = spark.createDataFrame([(m,), (None,)], "m array<array<int>>")
    assert [r["a"] for r in df.select(R.mask_answer(F.col("m"), 8, 8, close=2, cell=4).alias("a")).collect()] == ["1*2;1*2;", None]


def test_open_ended(spark):
    df = spark.createDataFrame([(k, "find the {categories}", "Storage-Tank") for k in range(40)] + [(99, "x {categories}", "odd")], "id bigint, t string, n string")
    syn = spark.createDataFrame([("storage tank", "tank"), ("storage tank", "silo")], "name string, synonym string")
    got = R.open_ended(df, "t", "n", syn, "id").collect()
    assert {r["n"] for r in got} == {"tank", "silo", "odd"} and all("{" not in r["t"] for r in got) and len(got) == 41


def test_messages(spark):
    df = spark.createDataFrame([(1, "a.png", "x")], "idx int, image_id string, question string")
    m = B.build_prompts(df, "qa", F.col("question"), F.col("image_id"))
    assert [tuple(r) for r in R.media_of(m, "idx").collect()] == [(1, 0, 0, "image", "file://a.png")]
    lim = m.select(R.with_vision_limits(F.col("message"), 4, 9).alias("m")).first()["m"][0]["content"]
    assert (lim[0]["min_pixels"], lim[0]["max_pixels"], lim[1]["max_pixels"]) == (4, 9, None)
    assert m.select(R.add_to_last_user_text(F.col("message"), " /no_think").alias("m")).first()["m"][0]["content"][1]["text"] == "x /no_think"


def test_small_ones(spark):
    assert one(spark, R.expand_vision_pads(F.lit("a<pad>b<pad>c"), F.array(F.lit(2), F.lit(3)))) == "a<pad><pad>b<pad><pad><pad>c"
    assert one(spark, R.data_url(F.lit(b"abc"))) == "data:image/png;base64,YWJj"
    assert one(spark, R.flatten_coords(F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))))) == [[1, 2, 3, 4]]
    df = spark.range(5)
    assert [r["id"] for r in R.ordered_pick(df, "id", [3, 9, 0]).collect()] == [3, 0]
    u = spark.range(2000).select(R.uniform("id", 5).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert 0.45 < u[0] < 0.55 and u[1] >= 0 and u[2] < 1
    s = spark.range(1).select(R.random_size(F.lit(400.0), F.lit(300.0), "id", 1).alias("s")).first()["s"]
    assert s["h"] % 28 == 0 and s["w"] % 28 == 0

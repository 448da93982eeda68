import pytest
from pyspark.sql import functions as F

from vellumkit.operators import curation as C
from vellumkit.operators.ranking import mixed_key, rank_within


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_rank_within_skew_ties_nulls(spark):
    rows = [(None, 3), (None, None), *[("hot", k % 7) for k in range(200)], ("a", 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id bigint, g string, v int")
    got = rank_within(df, "g", ["v", "id"], "r", "n").collect()
    for g in (None, "hot", "a"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])
        assert [r["r"] for r in own] == list(range(len(own))) and all(r["n"] == len(own) for r in own)
        assert [(r["v"] is not None, r["v"] or 0, r["id"]) for r in own] == sorted((r["v"] is not None, r["v"] or 0, r["id"]) for r in own)
    assert rank_within(df.where("false"), "g", ["v"]).count() == 0


@pytest.mark.parametrize("n,shards", [(10, 3), (7, 7), (3, 5)])
def test_shards_are_ntile(spark, n, shards):
    got = sorted((r["id"], r["shard"]) for r in C.shard_contiguous(spark.range(n), shards, ["id"]).collect())
    size, more = divmod(n, shards)
    want = [s for s in range(shards) for _ in range(size + (s < more))]
    assert [s for _, s in got] == want


def test_samples(spark):
    df = spark.range(10)
    a, b = ids(C.sample_exact(df, 0.5, "id", 7)), ids(C.sample_exact(df, 0.5, "id", 1))
    assert len(a) == len(b) == 5 and a != b  # a seed is honoured
    assert a == ids(C.sample_exact(df.repartition(3), 0.5, "id", 7))
    assert len(ids(C.sample_exact(df, 0.05, "id", at_least=1))) == 1 and ids(C.sample_exact(df, 0.05, "id")) == []
    assert C.oversample(df, 3).count() == 30 and C.sample_by_rate(df, 2.0, "id").count() == 20
    with pytest.raises(ValueError):
        C.oversample(df, 1.5)
    with pytest.raises(ValueError):
        C.sample_exact(df, 1.5, "id")


def test_split_and_key(spark):
    df = spark.range(100).withColumn("c", F.when(F.col("id") < 90, "x"))
    got = C.stratified_split(df, "c", 0.75, "id").groupBy("c").pivot("split", ["train", "test"]).count().collect()
    assert {r["c"]: (r["train"], r["test"]) for r in got} == {"x": (67, 23), None: (7, 3)}
    assert spark.range(5000).select(mixed_key("id", 3).alias("k")).distinct().count() > 4990
    assert spark.range(1).select(F.lit(None).cast("bigint").alias("id")).select(mixed_key("id", 3).alias("k")).first()["k"] is None


def test_icl_is_the_loop(spark):
    """The window against the scan it stands for."""
    rows = [(k, "abca"[k % 4] if k < 9 else "d") for k in range(12)]
    df = spark.createDataFrame(rows, "pos int, resp string")
    for shots in (1, 3, 4, 6, 12, 20):
        chosen, rest, seen = [], [], set()
        for pos, resp in rows:
            if resp in seen:
                rest.append(pos)
            elif len(chosen) < shots:
                chosen.append(pos)
                seen.add(resp)
            else:
                break
        chosen += rest[: shots - len(chosen)]
        got = C.icl_select(df, F.col("resp"), ["pos"], shots, unique=True).orderBy("shot").collect()
        assert [r["pos"] for r in got] == chosen
    assert [r["pos"] for r in C.icl_select(df, F.col("resp"), ["pos"], 2).orderBy("shot").collect()] == [0, 1]


def test_sets_and_catalog(spark):
    a, b = spark.range(2), spark.range(2).withColumn("x", F.lit(1))
    assert C.union_all([a, b]).where("x is null").count() == 2
    sizes = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "name string, n bigint")
    got = C.locate(spark.range(6).withColumnRenamed("id", "idx"), sizes, "name", "n").orderBy("idx").collect()
    assert [(r["name"], r["local_idx"]) for r in got] == [("a", 0), ("a", 1), ("c", 0), ("c", 1), ("c", 2)]
    catalog = spark.createDataFrame([("p",), ("q",)], "name string")
    asked = spark.createDataFrame([("all%10",), ("p*3",)], "request string")
    assert sorted((r["name"], r["rate"]) for r in C.expand_catalog(catalog, asked).collect()) == [("p", 0.1), ("p", 3.0), ("q", 0.1)]
    d = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    assert ids(C.dedup_keep_first(d, ["k"], ["id"])) == [1, 3]


def test_joins_are_checked_by_what_a_side_holds(spark):
    from vellumkit import runtime as R

    small = spark.createDataFrame([(1, "x" * 1000, [1, 2, 3]), (2, None, None)], "k long, s string, a array<long>")
    assert R.bytes_of(small, 10) == 2 * 10 + 1000 + 3 * 16 and R.bytes_of(small.where("false")) == 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    limit, R.BROADCAST_LIMIT_BYTES = R.BROADCAST_LIMIT_BYTES, 500
    try:
        assert "BroadcastHashJoin" not in plan(R.join_checked(spark.range(9), small, F.col("id") == F.col("k"), "inner"))
        assert "BroadcastHashJoin" in plan(R.join_checked(spark.range(9).withColumnRenamed("id", "k"), small.select("k"), "k", "inner"))
    finally:
        R.BROADCAST_LIMIT_BYTES = limit
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_tables(spark):
    from vellumkit import runtime as R

    back, path = R.stored(spark.range(5).withColumn("t", F.lit("x")), "some")
    assert back.count() == 5 and path.startswith(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    assert R.removed(spark, path) and not R.removed(spark, path)

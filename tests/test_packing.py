from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vellumkit.operators import packing as P
from vellumkit.streaming import streams


def naive(lengths, capacity):
    """Best fit decreasing, by looking at every bin."""
    bins = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [b for b in bins if sum(lengths[i] for i in b) + lengths[k] <= capacity]
        (max(fits, key=lambda b: sum(lengths[i] for i in b)).append(k) if fits else bins.append([k]))
    return bins


@given(st.lists(st.integers(0, 120), max_size=60), st.integers(1, 100))
@settings(max_examples=150, deadline=None)
def test_bins(lengths, capacity):
    bins = P.pack_best_fit(lengths, capacity)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= capacity or (len([k for k in b if lengths[k]]) == 1) for b in bins)
    sizes = lambda bs: sorted(sum(lengths[k] for k in b) for b in bs)
    assert sizes(bins) == sizes(naive(lengths, capacity))


def test_interval_carries_its_last_bin():
    groups, rest = P.pack_interval([(1, 6), (2, 5), (3, 4)], 10, False)
    assert groups == [[(1, 6), (3, 4)]] and rest == [(2, 5)]
    assert P.pack_interval(rest, 10, True) == ([[(2, 5)]], [])
    assert P.pack_interval([], 10, False) == ([], [])


def test_pack_frame(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 900 + 1).alias("n"))
    out = P.pack(df, "id", "n", "id", shards=3, interval=16, capacity=1000).collect()
    assert sorted(m["id"] for r in out for m in r["members"]) == list(range(500))
    assert all(r["total"] <= 1000 and r["total"] == sum(m["length"] for m in r["members"]) for r in out)
    assert len({(r["shard"], r["group_id"]) for r in out}) == len(out)
    assert P.pack(df.where("false"), "id", "n", "id").count() == 0
    ext = P.length_extremes(spark.createDataFrame(out), "total", 3).collect()
    assert sorted(r["side"] for r in ext) == ["largest"] * 3 + ["smallest"] * 3


def test_arrays(spark):
    df = spark.createDataFrame([(1, 1, [5, 6, 7]), (1, 2, [8])], "b int, o int, ids array<int>").withColumn("y", F.col("ids"))
    got = P.pad_batch(df, "b", "ids", "y").orderBy("o").collect()[1]
    assert (got["input_ids"], got["labels"], got["attention_mask"], got["position_ids"]) == ([8, 0, 0], [8, -100, -100], [1, 0, 0], [0, 1, 1])
    flat = P.flatten_group(df, "b", "o", "ids", "y").first()
    assert (flat["input_ids"], flat["labels"], flat["example_ids"], flat["position_ids"]) == ([5, 6, 7, 8], [-100, 6, 7, -100], [0, 0, 0, 1], [0, 1, 2, 0])
    assert P.flatten_group(df, "b", "o", "ids", "y", 2).first()["input_ids"] == [5, 6]
    r = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (2, 3, 99)], "b int, id int, n int")
    assert {x["id"]: x["source_id"] for x in P.replace_overlong(r, "b", "n", "id", 50).collect()} == {1: 1, 2: 1, 3: None}


def test_stream_packs_as_it_comes(spark, tmp_path):
    spark.range(200).select("id", (F.col("id") * 31 % 400 + 1).alias("length")).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, length bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_to_end(streams.pack_stream(stream, shards=2, interval=16, capacity=1000), "packed").collect()
    ids = [m["id"] for r in out for m in r["members"]]
    assert len(ids) == len(set(ids)) and 120 < len(ids) <= 200  # the rest waits in the state
    assert all(r["total"] <= 1000 for r in out)


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "a", 4.0)]
    spark.createDataFrame(rows, "ts string, k string, value double").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "k", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, k string, value double").parquet(str(tmp_path / "in"))
    out = streams.run_to_end(streams.windowed_counts(stream, "ts", "k"), "windows", "append").collect()
    assert [(r["n"], r["total"]) for r in out if r["window_start"].hour == 0] == [(2, 3.0)]

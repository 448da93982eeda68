"""Sinks and sources in pairs, and streams: tables are written in a source's form to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import curation as C, packing as P
from ..runtime import join_checked, place
from ..sources import readers as R, sinks as K
from ..streaming import streams
from .registry import Tables, query


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_scan(t: Tables) -> DataFrame:
    """JSON lines with a schema."""
    path = place(t.spark, "documents.jsonl")
    t.documents.write.json(path)
    return R.read_json_or_jsonl(t.spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_document_scan(t: Tables) -> DataFrame:
    """A document with a list, an item a row, a document for each region."""
    path = place(t.spark, "nations.json")
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n.groupBy("r_name").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "r_name"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_json_or_jsonl(t.spark, path, "n_nationkey int, n_name string, r_name string")


@query("SELECT s_suppkey AS id, n_name AS file_name, r_name AS category, (s_suppkey % 50 + 10)::DOUBLE AS x2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def coco_bundle_scan(t: Tables) -> DataFrame:
    """A bundle of images (nations), annotations (suppliers) and categories (regions)."""
    path = place(t.spark, "bundle.json")
    images = t.nation.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("file_name"), F.lit(10).alias("width"), F.lit(10).alias("height"))).alias("images"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    box = F.array((F.col("s_suppkey") % 50).cast("double"), F.lit(0.0), F.lit(10.0), F.lit(5.0))
    anns = s.agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("image_id"), F.col("n_regionkey").alias("category_id"), box.alias("bbox"))).alias("annotations"))
    cats = t.region.agg(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("categories"))
    images.crossJoin(anns).crossJoin(cats).select(F.to_json(F.struct("*")).alias("value")).write.text(path)  # a row
    images, anns, cats = R.read_coco(t.spark, path)
    anns = anns.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(cats.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")
    from ..functions.geometry import xywh_to_xyxy

    return anns.select("id", "file_name", "category", xywh_to_xyxy(F.col("bbox"))[2].alias("x2"))


@query("""SELECT 'o' || o_orderkey AS filename, 'test' AS split, l_returnflag AS name, 'no ' || l_linenumber AS description, l_quantity AS xmax FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'""")
def xml_object_scan(t: Tables) -> DataFrame:
    """Orders as annotations of one or many objects, of which the test split is read."""
    path = place(t.spark, "annotations")
    box = F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.col("l_quantity").alias("xmax"), F.lit(1.0).alias("ymax"))
    items = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), F.concat(F.lit("no "), "l_linenumber").alias("description"), box.alias("bndbox"))).alias("object"))
    o = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    o.select(F.concat(F.lit("o"), "o_orderkey").alias("filename"), F.when(F.col("o_orderstatus") == "O", "test").otherwise("train").alias("split"), "object").write.format("xml").option("rowTag", "annotation").option("rootTag", "annotations").option("maxRecordsPerFile", 20_000).save(path)  # a file is read by one task
    return R.read_xml_objects(t.spark, path, "test").select("filename", "split", "name", "description", F.col("bndbox.xmax").alias("xmax"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, label FROM embeddings")
def arrow_scan(t: Tables) -> DataFrame:
    """Partitions as Arrow streams, read back with the schema of the first."""
    path = place(t.spark, "arrow")
    R.arrow_files(t.embeddings.repartition(3)).write.parquet(path)
    return R.arrow_rows(t.spark.read.parquet(path)).select("vec_id", F.col("embedding")[0].cast("double").alias("first"), "label")


@query("""SELECT p_partkey % 40 AS x, p_size AS y, lower(replace(replace(p_brand, '#', ' '), '-', ' ')) AS class_name, (p_partkey % 2)::INT AS difficult, count(*) AS n FROM part GROUP BY ALL""")
def dota_scan(t: Tables) -> DataFrame:
    """Lines of corners, class and difficulty below two header lines."""
    path = place(t.spark, "labels")
    x, y = F.col("p_partkey") % 40, F.col("p_size")
    line = F.concat_ws(" ", x, y, x + 9, y, x + 9, y + 5, x, y + 5, F.replace(F.replace(F.col("p_brand"), F.lit(" "), F.lit("-")), F.lit("#"), F.lit("-")), F.col("p_partkey") % 2)
    head = t.region.select(F.concat(F.lit("imagesource:"), "r_name").alias("value")).union(t.region.select(F.lit("gsd:0.5")))
    t.part.select(line.alias("value")).union(head).write.text(path)
    got = R.read_dota(t.spark, path).groupBy(F.col("poly")[0].cast("bigint").alias("x"), F.col("poly")[1].cast("int").alias("y"), "class_name", "difficult").agg(F.count("*").alias("n"))
    return got.select("x", "y", "class_name", "difficult", "n")


@query("""SELECT 'Class_' || p_size AS class_name, 'P' || p_partkey || ' ' || printf('%.4f', p_size / 100) || ' ' || printf('%d.00 1.00 %d.00 1.00 %d.00 4.00 %d.00 4.00', p_partkey % 30, p_partkey % 30 + 5, p_partkey % 30 + 5, p_partkey % 30) AS line FROM part""")
def submission_lines(t: Tables) -> DataFrame:
    """K9: a line a detection, a folder a class."""
    path, x = place(t.spark, "submission"), (F.col("p_partkey") % 30).cast("double")
    poly = F.array(x, F.lit(1.0), x + 5, F.lit(1.0), x + 5, F.lit(4.0), x, F.lit(4.0))
    K.write_submission(t.part.select(F.concat(F.lit("P"), "p_partkey").alias("image"), F.concat(F.lit("Class_"), "p_size").alias("class_name"), (F.col("p_size") / 100).alias("score"), poly.alias("poly")), path)
    return t.spark.read.text(path).select("class_name", F.col("value").alias("line"))


@query("""WITH d AS (SELECT p_partkey // 4 AS image, p_partkey % 4 AS patch, p_size % 2 AS cls, p_retailprice AS score, p_partkey AS k FROM part), w AS (SELECT *, row_number() OVER (PARTITION BY image, cls, patch // 2 ORDER BY score DESC, k) AS r FROM d)
    SELECT 'I' || image AS image, cls::VARCHAR AS class_name, score, (100 * (patch // 2))::DOUBLE AS x FROM w WHERE r = 1""")
def merged_patches(t: Tables) -> DataFrame:
    """K9: the same object in two overlapping patches of an image stays once, with the better score."""
    k = F.col("p_partkey")
    patch = F.concat(F.lit("I"), F.floor(k / 4).cast("string"), F.lit("__2.0__"), (200 * F.floor(k % 4 / 2) + 40 * (k % 2)).cast("string"), F.lit("___0"))
    x = (-40 * (k % 2)).cast("double")  # in its patch; the patch is at twice the image's size
    poly = F.array(x, F.lit(0.0), x + 20, k / 1e7, x + 20, F.lit(10.0), x, F.lit(10.0))
    d = t.part.select(patch.alias("image"), (F.col("p_size") % 2).cast("string").alias("class_name"), F.col("p_retailprice").alias("score"), poly.alias("poly"))
    return K.merge_patches(d).select("image", "class_name", "score", F.col("poly")[0].alias("x"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 10 < 5")
def split_folders(t: Tables) -> DataFrame:
    """A folder a split, and the partitions that are asked for."""
    path, k = place(t.spark, "splits"), F.col("doc_id") % 10
    K.write_splits(t.documents.where("doc_id % 10 < 5").withColumn("split", F.when(k == 0, "val").when(k == 1, "test").otherwise("train")), path)
    read = t.spark.read.parquet(path)
    return read.where("split = 'val'").unionByName(read.where("split <> 'val'")).select("doc_id", "split")


@query("SELECT doc_id, n_chars FROM documents")
def packed_cache_scan(t: Tables) -> DataFrame:
    """Packed groups as JSON lines, with each sample in one group."""
    path = place(t.spark, "packed.jsonl")
    K.write_packed(P.pack(t.documents, "doc_id", "n_chars", "doc_id", capacity=8192), path)
    g = R.read_json_or_jsonl(t.spark, path, R.PACKED)
    return g.where("total = aggregate(members, 0L, (a, m) -> a + m.length) and (total <= 8192 or size(members) = 1)").select(F.explode("members").alias("m")).select(F.col("m.id").alias("doc_id"), F.col("m.length").alias("n_chars"))


@query("SELECT vec_id::VARCHAR AS image_id, label AS gt_idx, round(embedding[1]::DOUBLE, 6) AS ppl FROM embeddings ORDER BY ppl DESC, vec_id LIMIT 16")
def ranked_candidates_scan(t: Tables) -> DataFrame:
    """Candidates by falling score, and the best of them."""
    path = place(t.spark, "ranked.jsonl")
    K.write_ranked(t.embeddings.select(F.col("vec_id").cast("string").alias("image_id"), F.col("label").alias("gt_idx"), F.round(F.col("embedding")[0].cast("double"), 6).alias("ppl")), path)
    c = R.read_json_or_jsonl(t.spark, path, R.PPL)
    return c.orderBy(F.desc("ppl"), F.col("image_id").cast("bigint")).limit(16).select("image_id", "gt_idx", "ppl")


@query("SELECT doc_id, lang, text AS output FROM documents")
def saved_results_scan(t: Tables) -> DataFrame:
    """Results without their binary column."""
    path = place(t.spark, "results")
    K.write_results(t.documents.select("doc_id", "lang", F.col("text").alias("output"), F.encode("text", "UTF-8").alias("content")), path)
    return t.spark.read.parquet(path)


@query("SELECT 'mix' AS benchmark, unnest(['n', 'mean_chars']) AS metric, round(unnest([count(*)::DOUBLE, avg(n_chars)]), 6) AS value FROM documents UNION ALL SELECT 'pages', 'n', count(*) FROM pages")
def metric_log(t: Tables) -> DataFrame:
    """Metrics of two runs in one log."""
    path = place(t.spark, "metrics")
    K.write_metrics(t.documents.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")), path, "mix")
    K.write_metrics(t.pages.agg(F.count("*").alias("n")), path, "pages")
    return t.spark.read.parquet(path).where("at is not null").select("benchmark", "metric", "value")


@query("SELECT DISTINCT source AS benchmark FROM documents WHERE source NOT IN ('src0', 'src3')")
def resume_pending(t: Tables) -> DataFrame:
    """What the manifest doesn't list is left to do."""
    path, todo = place(t.spark, "manifest"), t.documents.select(F.col("source").alias("benchmark")).distinct()
    assert K.pending(todo, t.spark, path) is todo  # the first run has no manifest
    for done in ("src0", "src3"):
        K.mark_done(t.spark, path, done)
    return K.pending(todo, t.spark, path)


@query("SELECT p_partkey, p_partkey % 3 = 0 AS broken FROM part")
def quarantined_lines(t: Tables) -> DataFrame:
    """Lines that don't parse are set apart with their text."""
    path, k = place(t.spark, "rows.jsonl"), F.col("p_partkey")
    t.part.select(F.when(k % 3 == 0, F.concat(F.lit("{broken "), k)).otherwise(F.to_json(F.struct("p_partkey", "p_size"))).alias("value")).write.text(path)
    rows, _ = _kept(R.read_json_or_jsonl(t.spark, path, "p_partkey bigint, p_size int, _corrupt_record string"), "parsed")
    good, bad = K.split_bad_records(rows, F.col("_corrupt_record").isNull())
    return good.select("p_partkey", F.lit(False).alias("broken")).unionByName(bad.select(F.regexp_extract("_corrupt_record", r"(\d+)", 1).cast("bigint").alias("p_partkey"), F.lit(True).alias("broken")))


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    from ..runtime import stored

    return stored(df, name)


@query("""SELECT c_custkey, r.name, r.annotation_path FROM customer JOIN (SELECT unnest(['BUILDING', 'MACHINERY', 'both', 'both']) AS name, unnest(['b.json', 'm.json', 'b.json', 'm.json']) AS annotation_path, unnest(['BUILDING', 'MACHINERY', 'BUILDING', 'MACHINERY']) AS seg) r ON c_mktsegment = r.seg""")
def catalog_scan(t: Tables) -> DataFrame:
    """A catalog file whose entries name others."""
    path = place(t.spark, "catalog.json")
    text = '{"BUILDING": {"annotation_path": "b.json", "data_path": "BUILDING"}, "MACHINERY": {"annotation_path": "m.json", "data_path": "MACHINERY"}, "both": ["BUILDING", "MACHINERY"]}'
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    c = R.read_catalog(t.spark, f"{path}")
    return join_checked(t.customer, c, F.col("c_mktsegment") == F.col("data_path"), "inner").select("c_custkey", "name", "annotation_path")


@query("SELECT vec_id, (['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'])[label + 1] AS class_name FROM embeddings")
def labelled_split_scan(t: Tables) -> DataFrame:
    """Numbers of a class-label column by name; numbers beyond the names have none."""
    return R.read_labelled(t.embeddings, "label", list("abcdefgh")).select("vec_id", "class_name")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events) SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def stream_closed_windows(t: Tables) -> DataFrame:
    """A streaming query to a Parquet sink: windows come out once the watermark is past their end, the last ones don't."""
    spark = t.spark
    source, out, state = (place(spark, n) for n in ("events", "windows", "state"))
    t.events.coalesce(1).write.parquet(source)  # one file, so one micro-batch: nothing is late
    stream = spark.readStream.schema(t.events.schema).parquet(source)
    q = streams.windowed_counts(stream, "ts", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT doc_id AS id, n_chars AS length FROM documents")
def stream_packed_samples(t: Tables) -> DataFrame:
    """Packing of a stream with carried state: samples that came out in groups, and those still in the state of their shard, are all there are."""
    spark = t.spark
    source, out, state = (place(spark, n) for n in ("samples", "groups", "state"))
    t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("id bigint, length bigint").option("maxFilesPerTrigger", 1).parquet(source)
    q = streams.pack_stream(stream, shards=4, interval=32, capacity=8192).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(out).where("total <= 8192 or size(members) = 1").select(F.explode("members").alias("m")).select("m.id", "m.length")
    held = spark.read.format("statestore").load(state).select(F.explode(F.arrays_zip(*[F.col(f"value.groupState.{c}").alias(c) for c in ("ids", "lengths")])).alias("e")).select(F.col("e.ids").alias("id"), F.col("e.lengths").alias("length"))
    return done.unionByName(held)


@query("SELECT p_partkey, 'd' || p_partkey % 3 AS suite, p_name AS question FROM part WHERE p_partkey % 3 < 2")
def suite_scan(t: Tables) -> DataFrame:
    """The files of a suite, of two forms and columns, as one table with the name of each."""
    files = {}
    for k, name in ((0, "d0.json"), (1, "d1.jsonl")):
        files[f"d{k}"] = path = place(t.spark, name)
        rows = t.part.where(F.col("p_partkey") % 3 == k).select("p_partkey", F.col("p_name").alias("question"), *([F.lit(1).alias("more")] if k else []))
        if k:
            rows.write.json(path)
        else:
            rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return R.read_suite(t.spark, files).select("p_partkey", "suite", "question")


@query("SELECT page_id, 'i' || page_id || CASE WHEN page_id % 3 = 0 THEN '.jpg' WHEN page_id % 3 = 1 THEN '.png' ELSE '.jpg' END AS image FROM pages")
def existing_extensions(t: Tables) -> DataFrame:
    """A picture that isn't there under its name is taken with the other extension, if it is there with that."""
    name = F.concat(F.lit("i"), "page_id")
    there = t.pages.where("page_id % 3 < 2").select(F.concat(name, F.when(F.col("page_id") % 3 == 0, ".jpg").otherwise(".png")).alias("path"))
    return R.existing_extension(t.pages.select("page_id", F.concat(name, F.lit(".jpg")).alias("image")), "image", there).select("page_id", "image")

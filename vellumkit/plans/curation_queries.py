"""Dedup, splits, samples, shards, joins by position, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import curation as C, packing as P
from ..operators.ranking import mixed_key_sql
from ..runtime import join_checked
from ..streaming import streams
from .registry import Tables, query

_KEY = mixed_key_sql("doc_id", 42)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_keep_first(t: Tables) -> DataFrame:
    """The text goes no further than its 128-bit digest."""
    d = t.documents.select("doc_id", "source", F.md5(F.lower("text").cast("binary")).alias("key"))
    return C.dedup_keep_first(d, ["key"], ["doc_id"]).select("doc_id", "source")


@query(f"""SELECT doc_id, (ntile(7) OVER (ORDER BY {_KEY}, doc_id) - 1)::INT AS shard FROM documents""")
def shard_ntile(t: Tables) -> DataFrame:
    """W5."""
    from ..operators.ranking import mixed_key

    return C.shard_contiguous(t.documents.select("doc_id", mixed_key("doc_id", 42).alias("k")), 7, ["k", "doc_id"]).select("doc_id", "shard")


@query("""SELECT doc_id, idx, (idx % 4)::INT AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)""")
def rank_modulo(t: Tables) -> DataFrame:
    """W4, W6."""
    return C.shard_round_robin(C.with_dense_index(t.documents.select("doc_id"), ["doc_id"]), 4)


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.37)""")
def sample_fraction_exact(t: Tables) -> DataFrame:
    """O6."""
    return C.sample_exact(t.documents.select("doc_id"), 0.37, "doc_id", 42)


@query("""SELECT item_id, copy::INT AS copy FROM benchmark, (SELECT unnest([1, 2, 3]) AS copy)""")
def oversample_k(t: Tables) -> DataFrame:
    """O7."""
    return C.oversample(t.benchmark.select("item_id"), 3)


@query(f"""SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def stratified_split(t: Tables) -> DataFrame:
    """O10."""
    return C.stratified_split(t.documents.select("doc_id", "lang"), "lang", 0.8, "doc_id", 42)


@query(f"""SELECT doc_id FROM documents ORDER BY {_KEY}, doc_id LIMIT 25""")
def shuffle_clip(t: Tables) -> DataFrame:
    """O5, O11."""
    return C.shuffle_and_clip(t.documents.select("doc_id"), 25, "doc_id", 42)


_ICL = "SELECT vec_id, label::VARCHAR AS response, round(embedding[1]::DOUBLE, 6) AS ppl FROM embeddings"


def _candidates(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("label").cast("string").alias("response"), F.round(F.col("embedding")[0].cast("double"), 6).alias("ppl"))


@query(f"""SELECT vec_id, response, ppl, (row_number() OVER (ORDER BY ppl DESC, vec_id) - 1)::INT AS shot FROM ({_ICL}) ORDER BY ppl DESC, vec_id LIMIT 16""")
def icl_topk(t: Tables) -> DataFrame:
    """W1, O4."""
    return C.icl_select(_candidates(t), F.col("response"), [F.desc("ppl"), F.col("vec_id")], 16)


@query(f"""WITH c AS ({_ICL}), r AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY ppl DESC, vec_id) > 1 AS again FROM c)
    SELECT vec_id, response, ppl, (row_number() OVER (ORDER BY again, ppl DESC, vec_id) - 1)::INT AS shot FROM r ORDER BY again, ppl DESC, vec_id LIMIT 16""")
def icl_topk_unique(t: Tables) -> DataFrame:
    """W1, U4, U6."""
    return C.icl_select(_candidates(t), F.col("response"), [F.desc("ppl"), F.col("vec_id")], 16, unique=True)


@query(f"""WITH c AS ({_ICL}) SELECT vec_id, response, ppl, round::INT AS round FROM (SELECT *, row_number() OVER (PARTITION BY response ORDER BY ppl DESC, vec_id) AS round FROM c) ORDER BY round, ppl DESC, vec_id LIMIT 32""")
def hard_examples_roundrobin(t: Tables) -> DataFrame:
    """W2."""
    return C.hard_examples(_candidates(t), "response", "ppl", "vec_id", 32)


@query("""SELECT source, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY source""")
def dataset_mix_percent(t: Tables) -> DataFrame:
    """A25."""
    return C.mix_percent(t.documents, "source")


@query("""SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) + (SELECT count(*) FROM benchmark) AS n, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)) AS n_distinct""")
def distinct_media_union(t: Tables) -> DataFrame:
    """A26, U1, U2."""
    u = C.union_all([t.documents.select("doc_id"), t.labels.select("doc_id"), t.benchmark.select(F.col("item_id").alias("doc_id"))])
    return u.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_distinct"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(t: Tables) -> DataFrame:
    """U3."""
    return t.documents.select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_minus(t: Tables) -> DataFrame:
    """U4."""
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT lang, sum(n) OVER (ORDER BY lang) - n AS lo, sum(n) OVER (ORDER BY lang) AS hi FROM s), i AS (SELECT doc_id AS idx FROM documents)
    SELECT idx, lang, (idx - lo)::BIGINT AS local_idx FROM i JOIN b ON idx >= lo AND idx < hi""")
def global_index_range_join(t: Tables) -> DataFrame:
    """Which dataset, and which row of it, a global index is."""
    sizes = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return C.locate(t.documents.select(F.col("doc_id").alias("idx")), sizes, "lang", "n").select("idx", "lang", "local_idx")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e), r AS (SELECT user_id, g, event_type || '*' || count(*) AS run FROM g GROUP BY user_id, g, event_type)
    SELECT user_id, string_agg(run, ',' ORDER BY g) || ';' AS rle FROM r GROUP BY user_id""")
def rle_rows(t: Tables) -> DataFrame:
    """Run lengths of each user's events in order of time."""
    from ..functions.geometry import rle_rows as rle

    seq = t.events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("s"))
    return seq.select("user_id", rle(F.array("s")).alias("rle"))


@query("""SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) - 1)::INT AS frame FROM events""")
def frames_sorted(t: Tables) -> DataFrame:
    """Frames in the order of their dates."""
    e = t.events.withColumn("day", F.to_date(F.date_format("ts", "yyyy-MM-dd"), "yyyy-MM-dd"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "event_id"))).alias("f"))
    return g.select("user_id", F.posexplode("f").alias("frame", "e")).select("user_id", "e.event_id", "frame")


@query()
def pack_best_fit(t: Tables) -> DataFrame:
    """Documents packed into sequences of 8,192 characters."""
    return P.pack(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", "doc_id", shards=8, interval=64, capacity=8192)


@query("""WITH v AS (SELECT vec_id, label, list_transform(range(1 + vec_id % 5), lambda i: (vec_id + i)::INT) AS ids FROM embeddings), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY label) AS m FROM v)
    SELECT vec_id, list_concat(ids, list_transform(range(m - len(ids)), lambda i: 0::INT)) AS input_ids, list_concat(list_transform(ids, lambda x: CASE WHEN x % 2 = 0 THEN x ELSE -100 END::INT), list_transform(range(m - len(ids)), lambda i: (-100)::INT)) AS labels,
        list_concat(list_transform(ids, lambda x: 1::INT), list_transform(range(m - len(ids)), lambda i: 0::INT)) AS attention_mask, list_concat(list_transform(range(len(ids)), lambda i: i::INT), list_transform(range(m - len(ids)), lambda i: 1::INT)) AS position_ids FROM m""")
def pad_batch(t: Tables) -> DataFrame:
    """A batch a label, padded on the right."""
    ids = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("vec_id") % 5), lambda i: (F.col("vec_id") + i).cast("int"))
    v = t.embeddings.select("vec_id", "label", ids.alias("ids"))
    v = v.withColumn("y", P.mask_labels(F.col("ids"), F.transform("ids", lambda x: x % 2 == 0)))
    return P.pad_batch(v.withColumnRenamed("label", "batch"), "batch", "ids", "y").select("vec_id", "input_ids", "labels", "attention_mask", "position_ids")


@query("""WITH l AS (SELECT l_orderkey, list({n: l_linenumber, p: (l_partkey % 100)::INT, s: (l_suppkey % 100)::INT} ORDER BY l_linenumber, l_partkey % 100, l_suppkey % 100) AS m FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, flatten(list_transform(m, lambda e: [e.p, e.s])) AS input_ids, flatten(list_transform(m, lambda e: [-100, e.s])) AS labels, flatten(list_transform(range(len(m)), lambda k: [k::INT, k::INT])) AS example_ids, flatten(list_transform(m, lambda e: [0::INT, 1::INT])) AS position_ids FROM l""")
def flatten_group(t: Tables) -> DataFrame:
    """An order's items as one sequence."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.array((F.col("l_partkey") % 100).cast("int"), (F.col("l_suppkey") % 100).cast("int")).alias("ids"))
    return P.flatten_group(d, "l_orderkey", "l_linenumber", "ids", "ids")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_windowed_counts(t: Tables) -> DataFrame:
    """Tumbling windows by the streaming operator's expression, run as a batch."""
    out = streams.windowed_counts(t.events, "ts", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT c_custkey, r.name, r.rate FROM customer JOIN (SELECT 'BUILDING' AS name, 0.5::DOUBLE AS rate UNION ALL SELECT 'MACHINERY', 3.0::DOUBLE UNION ALL SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']), 0.1::DOUBLE) r ON c_mktsegment = r.name""")
def catalog_dispatch(t: Tables) -> DataFrame:
    """Requests expand against a catalog of five segments."""
    spark = t.spark
    catalog = spark.createDataFrame([(n,) for n in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")], "name string")
    asked = spark.createDataFrame([("BUILDING%50",), ("MACHINERY*3",), ("all%10",)], "request string")
    return join_checked(t.customer, C.expand_catalog(catalog, asked), F.col("c_mktsegment") == F.col("name"), "inner").select("c_custkey", "name", "rate")

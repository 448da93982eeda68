"""Conversations, regions and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..operators import messages as S, metrics as M, model
from .registry import Tables, query


def _conversations(t: Tables) -> DataFrame:
    """Conversations of two turns with two media tags in every third."""
    c = t.conversations.where("role <> 'system' and text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), F.col("text").alias("value")))).alias("c"))
    tag = lambda i: F.when((F.col("conv_id") % 3 == 0) & (i == 0), "<image>\nand <video>").otherwise("")
    conv = F.transform("c", lambda m, i: F.struct(m["from"].alias("from"), F.concat(tag(i), m["value"]).alias("value")))
    name = lambda kind: F.array(F.concat(F.lit(kind), F.col("conv_id").cast("string")))
    return c.select("conv_id", conv.alias("conv"), name("i").alias("images"), name("v").alias("videos"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, text AS v FROM conversations WHERE role <> 'system' AND text IS NOT NULL)
    SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS users, (CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS media, CASE WHEN conv_id % 3 = 0 THEN 'i' || conv_id || ',v' || conv_id ELSE '' END AS files FROM c GROUP BY conv_id""")
def conversation_to_messages(t: Tables) -> DataFrame:
    """Roles, tags and the files they take."""
    c = _conversations(t).withColumn("m", S.to_messages(S.repair_roles(F.col("conv")), F.col("images"), F.col("videos")))
    parts = F.flatten(F.transform("m", lambda x: x["content"]))
    media = F.filter(parts, lambda p: p["type"] != "text")
    return c.select("conv_id", F.size("m").cast("bigint").alias("turns"), F.size(F.filter("m", lambda x: x["role"] == "user")).cast("bigint").alias("users"), F.size(media).cast("bigint").alias("media"), F.array_join(F.transform(media, lambda p: p["media"]), ",").alias("files"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rr, text AS v FROM conversations WHERE role <> 'system' AND text IS NOT NULL)
    SELECT conv_id, string_agg(CASE WHEN conv_id % 3 = 0 AND r = 1 THEN '<image>' || chr(10) || 'and <video>' || v WHEN conv_id % 3 <> 0 AND role = 'user' AND rr = 1 THEN '<image>' || chr(10) || v ELSE v END, '|' ORDER BY turn) AS conv FROM c GROUP BY conv_id""")
def ensure_media_tag(t: Tables) -> DataFrame:
    """P16."""
    c = _conversations(t)
    return c.select("conv_id", F.array_join(F.transform(S.ensure_image_tag(F.col("conv"), F.lit(True)), lambda m: m["value"]), "|").alias("conv"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN left(text, 10) ELSE '[1, 2, 3, 5] ' || left(text, 10) END AS value, CASE WHEN conv_id % 2 = 0 THEN '[1, 2, 3, 4] ' || left(text, 10) END AS ori_value FROM conversations WHERE role = 'assistant' AND text IS NOT NULL""")
def turn_box_cleanup(t: Tables) -> DataFrame:
    """P18, F10, J16."""
    c = t.conversations.where("role = 'assistant' and text is not null")
    a = F.concat(F.when(F.col("conv_id") % 2 == 0, "[1, 2, 3, 4] ").otherwise("[1, 2, 3, 5] "), F.left("text", F.lit(10)))
    return c.select("conv_id", "turn", S.clean_turns(F.lit("What is at [1, 2, 3, 4]?"), a).alias("x")).select("conv_id", "turn", "x.value", "x.ori_value")


@query("""WITH c AS (SELECT r_regionkey AS id, lower(replace(r_name, '-', ' ')) AS name, row_number() OVER (ORDER BY lower(replace(r_name, '-', ' ')), r_regionkey) - 1 AS rank FROM region),
    a AS (SELECT c_nationkey AS image_id, c_custkey, rank, name, (c_custkey % 50)::DOUBLE AS x, (c_custkey % 40)::DOUBLE AS y, floor(c_custkey % 50 + 10.5) AS x2, floor(c_custkey % 40 + 7.25) AS y2 FROM customer JOIN c ON c.id = c_custkey % 5)
    SELECT n_nationkey AS id, count(image_id) AS n, coalesce(sum(x + y + x2 + y2), 0)::DOUBLE AS coords, (SELECT string_agg(name, ', ' ORDER BY rank) FROM c) AS categories, min(rank)::INT AS first_rank FROM nation LEFT JOIN a ON image_id = n_nationkey GROUP BY n_nationkey""")
def coco_denorm_nested(t: Tables) -> DataFrame:
    """Images are nations, annotations customers, categories regions."""
    images = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("file_name"))
    k = F.col("c_custkey")
    anns = t.customer.select(k.alias("id"), F.col("c_nationkey").cast("bigint").alias("image_id"), (k % 5).cast("int").alias("category_id"), F.array((k % 50).cast("double"), (k % 40).cast("double"), F.lit(10.5), F.lit(7.25)).alias("bbox"))
    cats = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    out = S.coco_images(images, anns, cats)
    total = F.aggregate(F.flatten(F.transform("annotations", lambda a: a["bbox"])), F.lit(0.0), lambda a, v: a + v)
    return out.select(F.col("id").cast("int").alias("id"), F.size("annotations").cast("bigint").alias("n"), total.alias("coords"), "categories", F.array_min(F.transform("annotations", lambda a: a["rank"])).alias("first_rank"))


@query("""SELECT o_orderkey AS ref_id, l_linenumber AS sent_id, l_shipdate::DATE::VARCHAR AS sent, c_name AS file_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'""")
def ref_index_joins(t: Tables) -> DataFrame:
    """References are orders, sentences their items, images their customers."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("sent_id"), F.to_date("l_shipdate").cast("string").alias("sent"))).alias("sentences"))
    refs = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderkey").alias("ann_id"), F.col("o_custkey").alias("image_id"), F.col("o_orderstatus").alias("split"), "sentences")
    anns = t.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice")).alias("bbox"))
    images = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_name"))
    return S.refer_sentences(S.refer_filter(refs, "F"), anns, images).select("ref_id", "sent_id", "sent", "file_name")


@query("""SELECT o_orderkey, coalesce(c.c_name, 'none') AS name, o_orderstatus FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c_custkey = o_custkey""")
def pred_gt_left_join(t: Tables) -> DataFrame:
    """J3."""
    pred = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), F.lit("none").alias("name"), "o_orderstatus")
    truth = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return S.pred_with_truth(pred, truth, "key", ["name"]).select("o_orderkey", "name", "o_orderstatus")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS answer FROM part""")
def answers_position_join(t: Tables) -> DataFrame:
    """A question number beyond the answers has none."""
    return S.answers_by_position(t.part.select("p_partkey", (F.col("p_partkey") % 5).alias("question_id")), F.array(*map(F.lit, "abc")), "question_id").select("p_partkey", "answer")


@query("""WITH j AS (SELECT l_linenumber AS k1, (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END - CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END - 1)::INT AS k2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey), h AS (SELECT k1, k2, count(*) AS n FROM j GROUP BY ALL)
    SELECT k1, k2, n, (sum(n) OVER (ORDER BY k1, k2) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY k1, k2))::BIGINT AS "end" FROM h""")
def compare_join_sortkey(t: Tables) -> DataFrame:
    """J5, A28, O3."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    k2 = F.when(F.col("o_orderstatus") == "F", 2).otherwise(0) - F.when(F.col("l_linestatus") == "F", 1).otherwise(0) - 1
    return M.diff_histogram(j, F.col("l_linenumber"), k2.cast("int"))


@query("""SELECT p_partkey, i::INT AS region_order, (['hbb', 'obb', 'polygon'])[i + 1] AS region_type FROM part, range(3) r(i)""")
def region_crossjoin(t: Tables) -> DataFrame:
    """J8, O2."""
    return S.region_todo(t.part.select("p_partkey"), "p_partkey", ["hbb", "obb", "polygon"])


@query("""SELECT doc_id, [contains(text, 'the')::INT, contains(text, 'que')::INT, contains(text, 'der')::INT] AS vec FROM documents""")
def multi_label_contains(t: Tables) -> DataFrame:
    """J15."""
    return t.documents.select("doc_id", S.class_vector(F.col("text"), ["the", "que", "der"]).alias("vec"))


_CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN left(c_mktsegment, 5) || 'x' ELSE c_mktsegment END AS label FROM customer), k AS (SELECT unnest({_CLASSES}) AS c),
    m AS (SELECT c_custkey, label, c, row_number() OVER (PARTITION BY c_custkey ORDER BY (c <> label), levenshtein(label, c), c) AS r FROM d, k) SELECT c_custkey, label, c AS matched FROM m WHERE r = 1""")
def fuzzy_label_fallback(t: Tables) -> DataFrame:
    """J12."""
    d = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.left("c_mktsegment", F.lit(5)), F.lit("x"))).otherwise(F.col("c_mktsegment")).alias("label"))
    return S.fuzzy_labels(d, "label", _CLASSES)


@query("""SELECT l_orderkey, string_agg(x || ',' || y || ',' || (x + 10) || ',' || (y + 5) || ' ship', chr(10) ORDER BY y, x) || chr(10) AS answer FROM (SELECT l_orderkey, (l_partkey % 90)::INT AS x, (l_suppkey % 70)::INT AS y FROM lineitem) GROUP BY l_orderkey""")
def detection_answers(t: Tables) -> DataFrame:
    """An order's items as sorted detections."""
    d = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 90).cast("int").alias("x"), (F.col("l_suppkey") % 70).cast("int").alias("y"))
    a = d.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit(0).alias("rank"), F.lit("ship").alias("name"), F.array("x", "y", F.col("x") + 10, F.col("y") + 5).alias("bbox"))).alias("anns"))
    return a.select("l_orderkey", S.detection_answer(F.col("anns"), as_json=False).alias("answer"))


@query("""SELECT p_partkey, (p_partkey % 90)::VARCHAR || ',2,3,4 buildings' || chr(10) AS answer, 'pre <b>' || p_size AS out, 'thought' AS think FROM part""")
def grounding_and_thinking(t: Tables) -> DataFrame:
    """X16, P17, P35."""
    text = F.concat(F.lit("["), (F.col("p_partkey") % 90).cast("string"), F.lit(", 2, 3, 4]"))
    th = X.split_thinking(F.concat(F.lit(" <think> thought </think> pre <b>"), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", X.grounding_answer(text, F.lit("<image> Identify the location of all buildings?")).alias("answer"), th["output"].alias("out"), th["think"].alias("think"))


@query("""SELECT p_partkey, [x1, y1, x2, y1, x2, y2, x1, y2] AS poly, (x2 - x1) * (y2 - y1) AS area FROM (SELECT p_partkey, (p_partkey % 30)::DOUBLE AS x1, (p_size % 20)::DOUBLE AS y1, (p_partkey % 30 + 10)::DOUBLE AS x2, (p_size % 20 + 4)::DOUBLE AS y2 FROM part)""")
def polygon_canonical(t: Tables) -> DataFrame:
    """Corners in any order come out clockwise from the top left."""
    x1, y1 = (F.col("p_partkey") % 30).cast("double"), (F.col("p_size") % 20).cast("double")
    x2, y2 = x1 + 10, y1 + 4
    mixed = F.array(x2, y2, x1, y1, x1, y2, x2, y1)
    p = t.part.select("p_partkey", G.normalize_polygon(mixed).alias("poly"))
    return p.withColumn("area", G.polygon_area(F.col("poly")))


@query("""WITH d AS (SELECT conv_id, text AS p, length(text) % 2 = 0 AND NOT contains(text, ' zoom ') AS again FROM conversations WHERE turn = 0 AND text IS NOT NULL), z AS (SELECT *, CASE WHEN again THEN p || ' zoom [1.0, 2.0, 3.0, ' || (4 + length(p) % 10) || '.0]' ELSE p END AS prompt FROM d)
    SELECT conv_id, prompt, 'seen ' || length(prompt) AS output, CASE WHEN again THEN 2 ELSE 1 END AS rounds FROM z""")
def zoom_chain_loop(t: Tables) -> DataFrame:
    """A stub model that asks for one zoom of every other prompt."""

    def factory():
        call = '<tool_call>{"name": "zoom_in", "arguments": {"bbox_2d": [1, 2, 3, %d]}}</tool_call>'
        return lambda b: b["prompt"].map(lambda p: call % (4 + len(p) % 10) if len(p) % 2 == 0 and " zoom " not in p else f"seen {len(p)}")

    d = t.conversations.where("turn = 0 and text is not null").select("conv_id", F.col("text").alias("prompt"))
    return model.zoom_loop(d, factory)

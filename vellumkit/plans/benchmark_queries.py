"""Prompt builders, formatters and metric routers over derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import benchmarks as B
from .registry import Tables, query


@query("""SELECT doc_id, 'find the ' || text AS prompt, 'file:///data/' || source || '/' || doc_id || '.png' AS image, 2 AS turns FROM documents
    UNION ALL SELECT -1 - doc_id, 'Locate the ' || text || ', output the bbox coordinates using JSON format', 'file:///data/' || source || '/' || doc_id || '.png', 1 FROM documents""")
def rec_prompts(t: Tables) -> DataFrame:
    """Messages of a grounding benchmark in plain form, and in JSON form (ids below 0)."""
    d = t.documents.select("doc_id", F.col("text").alias("normal_caption"), F.concat("source", F.lit("/"), "doc_id", F.lit(".png")).alias("image_id"))
    plain, as_json = B.prepare(d, "refcoco_val", "/data/", prompt_type="plain"), B.prepare(d.withColumn("doc_id", -1 - F.col("doc_id")), "refcoco_val", "/data/", prompt_type="json")
    of = lambda m: m.withColumn("u", F.element_at("message", -1)["content"]).select("doc_id", F.col("u")[1]["text"].alias("prompt"), F.col("u")[0]["media"].alias("image"), F.size("message").alias("turns"))
    return of(plain).unionByName(of(as_json))


_QA = "SELECT conv_id, min(CASE WHEN role = 'user' THEN text END) AS q, min(CASE WHEN role = 'assistant' THEN text END) AS a FROM conversations WHERE turn < 3 GROUP BY conv_id"


@query(f"""WITH c AS ({_QA}), r AS (SELECT conv_id, 'i' || (conv_id % 7) || '.png' AS image_id, CASE WHEN conv_id % 3 = 1 THEN 'referring' WHEN conv_id % 3 = 2 THEN 'caption' ELSE 'vqa' END AS type, conv_id % 5 AS k, q, a FROM c WHERE q IS NOT NULL AND a IS NOT NULL),
    f AS (SELECT conv_id AS question_id, image_id, type, CASE type WHEN 'referring' THEN 'ship ' || k WHEN 'caption' THEN NULL END AS normal_caption, CASE WHEN type = 'referring' THEN [1, k::INT, 3, 4] END AS solution, CASE WHEN type <> 'referring' THEN a END AS answer, row_number() OVER (PARTITION BY type, image_id, CASE type WHEN 'referring' THEN k::VARCHAR WHEN 'caption' THEN '' ELSE lower(q) END, CASE WHEN type <> 'referring' THEN lower(a) ELSE k::VARCHAR END ORDER BY conv_id) AS rn FROM r)
    SELECT question_id, image_id, type, coalesce(CASE WHEN type = 'referring' THEN normal_caption END, '') AS normal_caption, coalesce(array_to_string(solution, ','), '') AS solution, coalesce(answer, '') AS answer FROM f WHERE rn = 1""")
def format_conversations(t: Tables) -> DataFrame:
    """Conversations become typed rows, the first of each."""
    c = t.conversations.where("turn < 3").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("text"))).alias("q"), F.min(F.when(F.col("role") == "assistant", F.col("text"))).alias("a")).where("q is not null and a is not null")
    k, kind = (F.col("conv_id") % 5).cast("string"), F.col("conv_id") % 3
    q = F.when(kind == 1, F.concat(F.lit("<image>\nWhere is <p>The ship "), k, F.lit("</p>?"))).when(kind == 2, "<image>\nDescribe it").otherwise(F.concat(F.lit("<image>\n"), "q"))
    a = F.when(kind == 1, F.concat(F.lit("{<1><"), k, F.lit("><3><4>}"))).otherwise(F.col("a"))
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    rows = c.select(F.col("conv_id").alias("idx"), F.concat(F.lit("i"), (F.col("conv_id") % 7).cast("string"), F.lit(".png")).alias("image"), F.array(turn("human", q), turn("gpt", a)).alias("conversations"))
    return B.format_conversations(rows).select("question_id", "image_id", "type", F.coalesce("normal_caption", F.lit("")).alias("normal_caption"), F.coalesce(F.array_join(F.transform("solution", lambda v: v.cast("string")), ","), F.lit("")).alias("solution"), F.coalesce(F.get("ground_truth", F.lit(0)), F.lit("")).alias("answer"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS f, p_size AS s FROM part),
    v AS (SELECT 'presence_acc' AS metric, (k % 2)::DOUBLE AS v FROM p WHERE f = 0 UNION ALL SELECT 'color_acc', CASE WHEN k % 2 = 0 THEN 0.5 ELSE 1.0 END FROM p WHERE f = 1 UNION ALL SELECT 'modality_acc', (k % 2)::DOUBLE FROM p WHERE f = 2
        UNION ALL SELECT 'counting_mae', 2.0 FROM p WHERE f = 3 UNION ALL SELECT 'counting_mape', 2.0 / s FROM p WHERE f = 3 UNION ALL SELECT 'geometric_mae', x FROM (SELECT unnest([1.0, 0.5]) AS x FROM p WHERE f = 4)
        UNION ALL SELECT 'geometric_mape', x FROM (SELECT unnest([1.0 / s, 0.5 / (s + 1)]) AS x FROM p WHERE f = 4) UNION ALL SELECT 'cls_AID', (k % 2)::DOUBLE FROM p WHERE f = 5)
    SELECT metric, round(avg(v::DOUBLE), 6) AS value, count(*) AS n FROM v GROUP BY metric UNION ALL SELECT 'unsupported', -1, count(*) FROM p WHERE f = 6""")
def vhm_router(t: Tables) -> DataFrame:
    """Each folder's answers by its own rule."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % 7 + 1).cast("int"))
    odd = k % 2 == 1
    folder = pick("presence_mo_dota", "color_dota-test_fair1m-val_open", "imgType_mcq", "counting_dota-test_open", "obj_meas_dota_test", "cls_AID", "mlc_gid_test")
    out = pick(F.when(odd, "Yes.").otherwise("no"), F.when(odd, "red and blue").otherwise("light red"), F.when(odd, "it is B").otherwise("C"), F.concat(F.lit("about "), (s + 2).cast("string")), F.concat((s + 1).cast("string"), F.lit(" m by "), (s + 1.5).cast("string"), F.lit(" m")), F.when(odd, "a Beach.").otherwise("forest"), "x")
    gt = pick("yes", "red, blue", "B", s.cast("string"), F.concat(s.cast("string"), F.lit(" x "), (s + 1).cast("string")), "beach", "y")
    rows = t.part.select(folder.alias("image_path"), out.alias("output"), gt.alias("ground_truth"))
    return B.evaluate(rows, "vhm_hnstd_qa").select("metric", F.coalesce(F.round("value", 6), F.lit(-1.0)).alias("value"), "n")


_DMG = ["no damage", "minor damage", "major damage", "destroyed"]


@query(f"""WITH k AS (SELECT unnest({_DMG}) AS c), b AS (SELECT ({_DMG})[1 + p_partkey % 4] AS g, CASE WHEN p_partkey % 9 % 3 = 0 THEN ({_DMG})[1 + p_size % 4] WHEN p_partkey % 9 = 1 THEN 'unsure' ELSE ({_DMG})[1 + p_partkey % 4] END AS p, (p_size + 1) * (p_partkey % 9 + 2) AS a FROM part WHERE p_partkey % 11 > 0),
    s AS (SELECT c, coalesce((SELECT sum(a) FROM b WHERE g = c AND p = c), 0) AS tp, coalesce((SELECT sum(a) FROM b WHERE p = c AND g <> c), 0) AS fp, coalesce((SELECT sum(a) FROM b WHERE g = c AND p <> c AND p <> 'unsure'), 0) AS fn, coalesce((SELECT sum(a) FROM b WHERE g = c), 0) AS n FROM k),
    f AS (SELECT 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, n / (SELECT sum(a) FROM b) AS share FROM s)
    SELECT 'fmow_high_res_' || role || '_accuracy' AS metric, round(avg((conv_id % 2 = 0)::INT), 6) AS value, count(*) AS n FROM conversations GROUP BY role
    UNION ALL SELECT 'xbd_dmg_cls_change_detection_classification_f1', round(sum(f1 / share) / sum(1 / share), 6), 0 FROM f""")
def teochatlas_router(t: Tables) -> DataFrame:
    """Rules by dataset and task; boxes of parts, of varying area, are classified."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 9
    a = t.conversations.select(F.lit("FMoW_high_res").alias("dataset"), F.col("role").alias("task"), F.when(F.col("conv_id") % 2 == 0, "A Port!").otherwise("other").alias("output"), F.lit("a port").alias("ground_truth"), F.lit(None).cast("string").alias("polygon"))
    name = lambda i: F.element_at(F.array(*map(F.lit, _DMG)), (1 + i % 4).cast("int"))
    w, h = F.col("p_size").cast("string"), (n + 1).cast("string")  # with its outline a pixel more either way
    poly = F.concat(F.lit("POLYGON ((0 0, "), w, F.lit(" 0, "), w, F.lit(" "), h, F.lit(", 0 "), h, F.lit(", 0 0))"))
    out = F.when(n % 3 == 0, name(F.col("p_size"))).when(n == 1, "unsure").otherwise(name(k))
    b = t.part.select(F.lit("xBD_dmg_cls").alias("dataset"), F.lit("change_detection_classification").alias("task"), F.initcap(out).alias("output"), F.when(k % 11 == 0, "Unclassified").otherwise(name(k)).alias("ground_truth"), poly.alias("polygon"))
    return B.evaluate(a.unionByName(b), "teochatlas_all").select("metric", F.round("value", 6).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))

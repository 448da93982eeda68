"""Training samples, evaluation prompts, formatters and small parsers over derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..operators import benchmarks as B, curation as C, messages as S, packing as P, regions as R
from ..operators.ranking import mixed_key_sql
from ..sources import readers
from .registry import Tables, query

K = "p_partkey"


@query("SELECT p_partkey, r.n::INT AS region_order, r.t AS region_type FROM part, (SELECT unnest([0, 1, 2, 3]) AS n, unnest(['hbb', 'obb', 'polygon', 'seg']) AS t) r WHERE r.t <> 'seg' OR p_partkey % 3 = 0")
def region_samples(t: Tables) -> DataFrame:
    """A sample for each region type, of masks only where there is one."""
    return R.samples(t.part.select(K, (F.col(K) % 3 == 0).alias("mask_exists")), K, "refgeo").select(K, "region_order", "region_type")


@query(r"""WITH d AS (SELECT p_partkey AS k, (p_partkey % 50)::INT AS x, (p_size % 30)::INT AS y, (10 + p_size)::INT AS w, (3 + p_partkey % 7)::INT AS h FROM part),
    c AS (SELECT k, 'hbb' AS region, [x, y, x + w, y + h] AS c, 'bbox_2d' AS name FROM d UNION ALL SELECT k, 'obb', [(x + x + w) // 2, (y + y + h) // 2, w, h, 0], 'oriented bbox' FROM d UNION ALL SELECT k, 'polygon', [x, y, x + w, y, x + w, y + h, x, y + h], 'quadrant bbox' FROM d)
    SELECT k AS p_partkey, region, CASE WHEN k % 2 = 0 THEN '```json' || chr(10) || '[' || chr(10) || chr(9) || '{"' || name || '": [' || array_to_string(c, ', ') || '], "label": "ship"}' || chr(10) || ']' || chr(10) || '```' ELSE array_to_string(c, ',') || ' ship' || chr(10) END AS answer FROM c""")
def region_answers(t: Tables) -> DataFrame:
    """A rectangle, given by corners in any order, as box, rotated box and polygon, in JSON and as a line."""
    x, y, w, h = F.col(K) % 50, F.col("p_size") % 30, 10 + F.col("p_size"), 3 + F.col(K) % 7
    d = t.part.select(K, F.array(x, y, x + w, y + h).alias("box"), F.array(x + w, y + h, x, y, x, y + h, x + w, y).alias("poly"))
    d = d.select("*", F.explode(F.array(*map(F.lit, ("hbb", "obb", "polygon")))).alias("region"))
    return d.select(K, "region", R.region_answer(F.col("region"), R.coords_of(F.col("region"), F.col("box"), F.col("poly")), F.lit("ship"), F.col(K) % 2 == 0).alias("answer"))


@query(f"""SELECT p_partkey, (['find the', 'where is the', 'locate the'])[{mixed_key_sql("p_partkey", 42)} % 3 + 1] || ' ' || p_type AS prompt FROM part""")
def template_choice(t: Tables) -> DataFrame:
    """One of the templates by a seeded hash of the row."""
    return t.part.select(K, F.concat(S.choose_template(["find the", "where is the", "locate the"], K), F.lit(" "), "p_type").alias("prompt"))


@query(f"""SELECT p_partkey, 'List all the visible remote sensing objects.' AS prompt, CASE WHEN p_size % 3 = 0 THEN (['silo', 'tank'])[{mixed_key_sql("p_partkey", 42)} % 2 + 1] ELSE p_type END AS name FROM part""")
def open_ended_prompts(t: Tables) -> DataFrame:
    """P10: the list of categories goes, names become one of their synonyms."""
    syn = t.spark.createDataFrame([("storage tank", "tank"), ("Storage-Tank", "silo"), ("storage_tank", "tank")], "name string, synonym string")
    d = t.part.select(K, F.lit("List the {categories}.").alias("prompt"), F.when(F.col("p_size") % 3 == 0, "Storage_Tank").otherwise(F.col("p_type")).alias("name"))
    return R.open_ended(d, "prompt", "name", syn, K).select(K, "prompt", "name")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'file:///data/p/' || page_id || '.png' ELSE url END AS media, '/root/i/' || page_id || '.png' AS path FROM pages")
def rooted_media(t: Tables) -> DataFrame:
    """Local files go under a folder, web addresses stay."""
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("file://p/"), "page_id", F.lit(".png"))).otherwise(F.col("url"))
    return t.pages.select("page_id", S.prefix_file_urls(url, "/data").alias("media"), S.with_root(F.array(F.concat(F.lit("i/"), "page_id", F.lit(".png"))), "/root/")[0].alias("path"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 5 ELSE 2 END AS turns, CASE WHEN p_size % 3 = 1 THEN '<tool_call>' || chr(10) || '{"name": "zoom_in", "arguments": {"bbox_2d": [' || p_size || ', 1, 90, 80]}}' || chr(10) || '</tool_call>' ELSE 'a ' || p_type END AS said, 'a ' || p_type AS answer FROM part""")
def zoom_conversations(t: Tables) -> DataFrame:
    """A zoom where there is one crop, else question and answer."""
    crop = F.array(F.col("p_size") + 0.5, F.lit(1.9), F.lit(90.0), F.lit(80.2))
    crops = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<array<double>>")).when(F.col("p_size") % 3 == 1, F.array(crop)).otherwise(F.array(crop, crop))
    d = t.part.select(K, S.zoom_conversation(F.concat(F.lit("q "), "p_name"), F.concat(F.lit("a "), "p_type"), crops).alias("m"))
    first = F.filter("m", lambda x: x["role"] == "assistant")[0]["text"]
    return d.select(K, F.size("m").alias("turns"), first.alias("said"), F.element_at("m", -1)["text"].alias("answer"))


@query("""SELECT doc_id, p.kind AS kind, CASE WHEN p.kind = 'image' THEN 'file:///r/' || source || '/' || doc_id || '.jpg' ELSE '' END AS media, CASE WHEN p.kind = 'text' THEN text || ' /no_think' ELSE '' END AS text, CASE WHEN p.kind = 'image' THEN 64 ELSE -1 END::BIGINT AS min_pixels, CASE WHEN p.kind = 'image' THEN 4096 ELSE -1 END::BIGINT AS max_pixels FROM documents, (SELECT unnest(['image', 'text']) AS kind) p""")
def message_parts(t: Tables) -> DataFrame:
    """Parts of a message with the limits of its media and a suffix on its text."""
    d = t.documents.select("doc_id", F.col("text").alias("question"), F.concat("source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("image_id"))
    m = B.prepare(d, "vhm_hnstd_qa", "/r/").withColumn("message", R.with_vision_limits(R.add_to_last_user_text(F.col("message"), " /no_think"), 64, 4096))
    return m.select("doc_id", F.explode(F.element_at("message", -1)["content"]).alias("p")).select("doc_id", F.col("p.type").alias("kind"), *(F.coalesce(f"p.{c}", F.lit(v)).alias(c) for c, v in (("media", ""), ("text", ""), ("min_pixels", -1), ("max_pixels", -1))))


@query("""WITH d AS (SELECT p_partkey, p_name AS n FROM part) SELECT p_partkey, 'vqa' AS family, n || ' Answer in one word or a short phrase.' AS prompt FROM d UNION ALL SELECT p_partkey, 'cls', 'Classify the image within one of the given classes:' || n FROM d
    UNION ALL SELECT p_partkey, 'region', '[identify] What is the object present at ' || n FROM d UNION ALL SELECT p_partkey, 'caption', n FROM d UNION ALL SELECT p_partkey, 'qa', n FROM d""")
def evaluation_prompts(t: Tables) -> DataFrame:
    """Prompts of the families."""
    out = None
    for name, bench, column in (("vqa", "geochat_hrben", "question"), ("cls", "cls_aid_4", "classes"), ("region", "geochat_region_captioning", "question"), ("caption", "vrsbench_caption", "question"), ("qa", "teochatlas_all", "question")):
        m = B.prepare(t.part.select(K, F.col("p_name").alias(column), F.lit("i.png").alias("image_id")), bench, "/r")
        rows = m.select(K, F.lit(name).alias("family"), F.element_at("message", -1)["content"][1]["text"].alias("prompt"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT p_partkey, p_name || ' The choices are listed below:' || chr(10) || '(A) ' || p_type || chr(10) || '(B) ' || p_brand || chr(10) || 'Answer with the letter of the right choice and nothing else.' || chr(10) || 'Answer:' AS prompt FROM part""")
def choice_prompts(t: Tables) -> DataFrame:
    """P27."""
    return t.part.select(K, S.choice_question(F.col("p_name"), F.array(F.concat(F.lit("(A) "), "p_type"), F.concat(F.lit("(B) "), "p_brand"))).alias("prompt"))


@query("""SELECT lang || '/' || doc_id || '.png' AS image_id, lang AS ground_truth, 'own' AS dataset, 'cls' AS type, 'test' AS split, (SELECT string_agg(l, ',' ORDER BY l) || '.' FROM (SELECT DISTINCT lang AS l FROM documents)) AS classes FROM documents""")
def scene_class_rows(t: Tables) -> DataFrame:
    """The class is the folder; all classes in one string."""
    return B.format_classes(t.documents.select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".png")).alias("image_id"), F.lit("test").alias("split")), "own")


@query("""SELECT conv_id || '.png' AS image_id, 'Describe the image' AS question, 'own' AS dataset, 'caption' AS type, list(trim(text, chr(32) || chr(9) || chr(10) || chr(13)) ORDER BY turn) AS ground_truth, 'val' AS split FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def caption_rows(t: Tables) -> DataFrame:
    """The sentences of an image as one list."""
    c = t.conversations.where("text is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda e: F.struct(e["text"].alias("raw"))).alias("sentences"))
    return B.format_captions(c.select(F.concat("conv_id", F.lit(".png")).alias("filename"), "sentences", F.lit("val").alias("split")), "own")


@query("""SELECT 'i' || p_partkey || '.tif' AS image_id, lower(p_name) AS question, lower(p_type) AS ground_truth, p_brand AS category, 'vqa' AS type, p_partkey AS question_id FROM part""")
def renamed_rows(t: Tables) -> DataFrame:
    """Rows of another benchmark's form, cleaned."""
    d = t.part.select(F.concat(F.lit("i"), K, F.lit(".tif")).alias("image"), F.concat(F.upper("p_name"), F.lit(" \nAnswer in one word.")).alias("text"), F.upper("p_type").alias("answer"), F.col("p_brand").alias("category"), F.col(K).alias("question_id"))
    return B.format_geochat(d, "vqa")


@query("SELECT n_name AS file_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def images_with_annotations(t: Tables) -> DataFrame:
    """images (nations) without annotations (suppliers) go."""
    images = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    anns = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("image_id"), F.lit(1).alias("category_id"), F.array(*[F.lit(1.0)] * 4).alias("bbox"))
    out = S.coco_images(images, anns, t.spark.createDataFrame([(1, "x")], "id int, name string"), keep_empty=False)
    return out.select("file_name", F.size("annotations").cast("bigint").alias("n"))


@query("SELECT doc_id, n::INT AS place FROM documents JOIN (SELECT unnest([17, 3, 99, 3, 41]) AS id, unnest([0, 1, 2, 3, 4]) AS n) ON doc_id = id")
def frozen_examples(t: Tables) -> DataFrame:
    """Rows of a fixed list, in its order, repeats too."""
    return R.ordered_pick(t.documents.select("doc_id"), "doc_id", [17, 3, 99, 3, 41]).withColumnRenamed("pos", "place")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || ',1,2,3,4,5,6,7' ELSE p_size || ',1,2,3|4,5,6,' || p_size END AS plain, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || '.5,1.0,2.0,3.0' END AS fenced FROM part""")
def answer_boxes(t: Tables) -> DataFrame:
    """Boxes of a plain answer, of eight numbers or else of four; and of a fenced one, if it can be read."""
    s = F.col("p_size").cast("string")
    plain = F.when(F.col(K) % 2 == 0, F.concat(F.lit("at "), s, F.lit(",1,2,3,4,5,6,7 ship\n1,2,3,4 car"))).otherwise(F.concat(s, F.lit(",1,2,3 ship\n4,5,6,"), s))
    fenced = F.when(F.col(K) % 3 == 0, '```json\n[{"bbox_2d": [1, 2').otherwise(F.concat(F.lit('```json\n[{"bbox_2d": ['), s, F.lit('.5, 1, 2, 3], "label": "a"}]\n```')))
    joined = lambda b: F.array_join(b.cast("array<string>"), ",")
    return t.part.select(K, F.array_join(F.transform(X.plain_boxes(plain), joined), "|").alias("plain"), F.coalesce(joined(F.get(X.json_boxes(fenced), F.lit(0))["bbox_2d"]), F.lit("")).alias("fenced"))


@query("SELECT p_partkey, 'a' || repeat('<pad>', p_size % 4) || 'b' || repeat('<pad>', p_size % 3 + 1) || 'c' AS text FROM part")
def expanded_pads(t: Tables) -> DataFrame:
    """X18."""
    n = F.array((F.col("p_size") % 4).cast("int"), (F.col("p_size") % 3 + 1).cast("int"))
    return t.part.select(K, R.expand_vision_pads(F.lit("a<pad>b<pad>c"), n).alias("text"))


@query("SELECT p_partkey, round((p_size * 4.0::DOUBLE) / ((p_size + 10) * 8), 6) AS giou, round((p_size * 4.0::DOUBLE) / ((p_size + 10) * 8), 6) AS quads FROM part")
def nested_polygons(t: Tables) -> DataFrame:
    """GIoU of a polygon inside another, as boxes and as corners in any order."""
    s = F.col("p_size").cast("double")
    quad = lambda w, h: F.array(w, h, F.lit(0.0), F.lit(0.0), F.lit(0.0), h, w, F.lit(0.0))
    box = lambda w, h: F.array(F.lit(0.0), F.lit(0.0), w, h)
    g = lambda f: F.round(G.polygon_giou(f(s, F.lit(4.0)), f(s + 10, F.lit(8.0))), 6)
    return t.part.select(K, g(box).alias("giou"), g(quad).alias("quads"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [10.0 - p_size, 3, 10.0 + p_size, 3, 10.0 + p_size, 7, 10.0 - p_size, 7] ELSE [12.0, 5.0 - p_size, 12, 5.0 + p_size, 8, 5.0 + p_size, 8, 5.0 - p_size] END::DOUBLE[] AS corners FROM part")
def rotated_corners(t: Tables) -> DataFrame:
    """Corners of rotated boxes, upright and by a quarter turn."""
    b = F.array(F.lit(10.0), F.lit(5.0), F.col("p_size") * 2.0, F.lit(4.0), F.when(F.col(K) % 2 == 0, F.lit(0.0)).otherwise(F.pi() / 2))
    return t.part.select(K, F.transform(G.rbox_to_qbox(b), lambda v: F.round(v, 6) + 0.0).alias("corners"))


@query("""WITH d AS (SELECT s_suppkey AS k, 10 + s_suppkey % 40 AS w, 5 + s_suppkey % 30 AS h, s_suppkey % 7 AS dx FROM supplier) SELECT k AS s_suppkey, ((w + 1 - dx) * (h + 1))::BIGINT AS tp, (dx * (h + 1))::BIGINT AS fp, (dx * (h + 1))::BIGINT AS fn, (65536 - (w + 1 + dx) * (h + 1))::BIGINT AS tn FROM d""")
def mask_overlaps(t: Tables) -> DataFrame:
    """G9, A12i: pixels of two boxes as masks with their outlines, one shifted."""
    k = F.col("s_suppkey")
    w, h, dx = (10 + k % 40).cast("double"), (5 + k % 30).cast("double"), (k % 7).cast("double")
    quad = lambda x: F.array(F.array(x, F.lit(0.0), x + w, F.lit(0.0), x + w, h, x, h))
    return t.supplier.select("s_suppkey", G.mask_counts(quad(dx), quad(F.lit(0.0))).alias("c")).select("s_suppkey", "c.tp", "c.fp", "c.fn", "c.tn")


@query("(SELECT 'smallest' AS side, n_chars FROM documents ORDER BY n_chars LIMIT 10) UNION ALL (SELECT 'largest', n_chars FROM documents ORDER BY n_chars DESC LIMIT 10)")
def length_extremes(t: Tables) -> DataFrame:
    """A27."""
    return P.length_extremes(t.documents, "n_chars")


@query("""WITH a AS (SELECT p_partkey % 5 AS task, lower(p_type) AS g, CASE WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 4 = 1 THEN 'syn of ' || p_type ELSE 'other' END AS p FROM part) SELECT task, round(avg((g = lower(p) OR p LIKE 'syn of %')::INT), 6) AS acc, count(*) AS n FROM a GROUP BY task""")
def synonym_accuracy(t: Tables) -> DataFrame:
    """An answer counts if it shares a synset with the truth."""
    kinds = t.part.select(F.col("p_type").alias("lemma")).distinct()
    syn = kinds.select("lemma", F.lower("lemma").alias("synset")).unionByName(kinds.select(F.concat(F.lit("Syn of "), "lemma").alias("lemma"), F.lower("lemma").alias("synset")))
    out = F.when(F.col("p_size") % 4 == 0, F.col("p_type")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("syn of "), "p_type")).otherwise("other")
    rows, ok = B.with_synonyms(t.part.select((F.col(K) % 5).alias("task"), F.upper("p_type").alias("ground_truth"), out.alias("output")), syn)
    return rows.groupBy("task").agg(F.round(F.avg(ok.cast("double")), 6).alias("acc"), F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' dogs cat' WHEN 1 THEN '2 x' || p_size || ' isn''t' WHEN 2 THEN '0' ELSE p_size || '.5 m s' END AS answer FROM part""")
def normalized_answers(t: Tables) -> DataFrame:
    """Commas, articles, number words, contractions and marks."""
    k, s = F.col(K), F.col("p_size").cast("string")
    raw = F.when(k % 4 == 0, F.concat(s, F.lit(" dogs, a cat."))).when(k % 4 == 1, F.concat(F.lit("The two x"), s, F.lit(" isnt?"))).when(k % 4 == 2, "None").otherwise(F.concat(s, F.lit(".5 m/s")))
    return t.part.select(K, X.normalize_answer(raw).alias("answer"))


@query("""SELECT source || CASE doc_id % 3 WHEN 0 THEN '_unique_' || (doc_id % 16) WHEN 1 THEN '_' || (doc_id % 16) ELSE '' END AS benchmark, source AS name, CASE WHEN doc_id % 3 < 2 THEN doc_id % 16 ELSE 0 END::INT AS shots, doc_id % 3 = 0 AS is_unique, count(*) AS n FROM documents GROUP BY ALL""")
def benchmark_names(t: Tables) -> DataFrame:
    """A23, E2."""
    k = F.col("doc_id")
    name = F.concat("source", F.when(k % 3 == 0, F.concat(F.lit("_unique_"), k % 16)).when(k % 3 == 1, F.concat(F.lit("_"), k % 16)).otherwise(""))
    return t.documents.select(name.alias("benchmark"), X.benchmark_suffix(name).alias("b")).groupBy("benchmark", "b.name", "b.shots", "b.is_unique").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url, 'inline' AS scheme, text AS back FROM documents")
def inline_media(t: Tables) -> DataFrame:
    """Bytes as a data URL, and back."""
    d = t.documents.select("doc_id", R.data_url(F.encode("text", "UTF-8")).alias("url"))
    s = readers.media_source(F.col("url"))
    return d.select("doc_id", "url", s["scheme"].alias("scheme"), F.decode(s["content"], "UTF-8").alias("back"))


@query("SELECT page_id, page_id % 4 = 0 AS image, page_id % 4 = 1 AS video FROM pages")
def media_by_name(t: Tables) -> DataFrame:
    """Kinds by extension, whatever its case and what follows it."""
    k = F.col("page_id")
    name = F.concat(F.lit("d.x/a"), k.cast("string"), F.when(k % 4 == 0, ".JPG?w=1").when(k % 4 == 1, ".mp4#t").when(k % 4 == 2, ".txt").otherwise(""))
    return t.pages.select("page_id", readers.is_image(name).alias("image"), readers.is_video(name).alias("video"))


@query("SELECT p_partkey FROM part WHERE p_size % 5 > 1")
def well_formed_boxes(t: Tables) -> DataFrame:
    """boxes of fewer than four numbers, with nulls, or missing, go."""
    box = F.when(F.col("p_size") % 5 == 0, F.array(F.lit(1.0))).when((F.col("p_size") % 5 == 1) & (F.col(K) % 2 == 0), F.array(F.lit(1.0), F.lit(None), F.lit(3.0), F.lit(4.0))).when(F.col("p_size") % 5 > 1, F.array(*[F.lit(1.0)] * 4))
    return C.drop_malformed(t.part.select(K, box.alias("box")), "box").select(K)


@query("SELECT r_name AS dataset_type, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def catalog_by_type(t: Tables) -> DataFrame:
    """A24."""
    c = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit("p").alias("annotation_path"), F.col("r_name").alias("dataset_type"))
    return C.configs_by_type(c).select("dataset_type", F.transform("configs", lambda e: e["name"]).alias("names"))


@query("SELECT p_partkey, [p_size, 1, 2, p_size + 3]::DOUBLE[] AS flat FROM part")
def flat_corners(t: Tables) -> DataFrame:
    """Points become one list of numbers."""
    pts = F.array(F.array(F.array(F.col("p_size").cast("double"), F.lit(1.0)), F.array(F.lit(2.0), F.col("p_size") + 3.0)))
    return t.part.select(K, R.flatten_coords(pts)[0].alias("flat"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 400 * 300 // 400)::INT AS x, (l_suppkey % 300 * 600 // 300)::INT AS y FROM lineitem")
def scaled_coordinates(t: Tables) -> DataFrame:
    """Coordinates of one image size in another, cut to whole numbers."""
    c = G.resize_coords(F.array((F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") % 300).cast("double")), F.lit(400), F.lit(300), F.lit(300), F.lit(600))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c[0].alias("x"), c[1].alias("y"))


@query("""WITH d AS (SELECT s_suppkey AS k, (1 + s_suppkey % 9)::INT AS x, (1 + s_suppkey % 5)::INT AS y, (2 + s_suppkey % 4)::INT AS w, (1 + s_suppkey % 6)::INT AS h FROM supplier)
    SELECT k AS s_suppkey, list_concat([x * 20 + y, h + 1], flatten(list_transform(range(w), lambda i: [20 - h - 1, h + 1])), [20 * 30 - (x + w) * 20 - y - h - 1])::INT[] AS runs, ((w + 1) * (h + 1))::BIGINT AS area FROM d""")
def mask_runs(t: Tables) -> DataFrame:
    """Boxes as run lengths of their masks, column by column."""
    k = F.col("s_suppkey")
    x, y, w, h = (v.cast("double") for v in (1 + k % 9, 1 + k % 5, 2 + k % 4, 1 + k % 6))
    return t.supplier.select("s_suppkey", G.polygon_runs(F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h)), 20, 30).alias("r")).select("s_suppkey", "r.runs", "r.area")


@query("""SELECT p_partkey, b.box AS det_box, q.kind AS prompt_type, CASE WHEN q.kind = 'json' THEN 'Locate every item of these categories and answer in JSON: ' || p_type || '.' ELSE 'find the ' || p_type || '.' END AS prompt FROM part, (SELECT unnest(['hbox', 'rbox', 'qbox']) AS box) b, (SELECT unnest(['json', 'plain']) AS kind) q""")
def detection_prompts(t: Tables) -> DataFrame:
    """Each form of box with each form of prompt."""
    m = B.detection_matrix(t.part.select(K, F.col("p_type").alias("categories"), F.concat(F.lit("i"), K).alias("image_id"), "p_size"), "dota_val", "/r", instances="p_size")
    return m.select(K, "det_box", "prompt_type", F.element_at("message", -1)["content"][1]["text"].alias("prompt"))

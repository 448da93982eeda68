"""Benchmarks by name: how their rows become prompts, and how answers become tidy metrics (metric, value, n).

Both sides are tables of rules, so a benchmark is added by a row, not by a branch.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as X
from ..runtime import join_checked
from . import detection as D, metrics as M

# --- prompts -------------------------------------------------------------------------------------------------------

_BOX_LINE, _QUAD_LINE, _ROTATED_LINE = "x1,y1,x2,y2 label", "x1,y1,x2,y2,x3,y3,x4,y4 label", "x,y,w,h,a label"
#: (family, prompt type) -> (system text or None, user text); {name} stands for a column of the row.
PROMPTS: dict[tuple[str, str], tuple[str | None, str]] = {
    ("rec", "json"): (None, "Locate the {target}, output the bbox coordinates using JSON format"),
    ("rec", "plain"): (f"Answer with detections as lines of '{_BOX_LINE}'.", "find the {target}"),
    ("referring", "json"): (None, "List every {target} in JSON, each with the four corners of its quadrant bbox"),
    ("referring", "plain"): (None, f"Find all {{target}}, as lines of '{_QUAD_LINE}'"),
    ("caption", ""): (None, "{target}"),
    ("region_caption", ""): (None, "[identify] What is the object present at {target}"),
    ("vqa", ""): (None, "{target} Answer in one word or a short phrase."),
    ("qa", ""): (None, "{target}"),
    ("cls", ""): (None, "Classify the image within one of the given classes:{target}"),
    ("det_qbox", "json"): ("Detect oriented objects; give the corners of each box clockwise, as its quadrant bbox.", "Locate every item of these categories and answer in JSON: {target}."),
    ("det_qbox", "plain"): (f"Detect oriented objects as lines of '{_QUAD_LINE}'.", "find the {target}."),
    ("det_rbox", "json"): ("Detect oriented objects; give center, width, height and angle of each.", "Locate every item of these categories and answer in JSON: {target}."),
    ("det_rbox", "plain"): (f"Detect oriented objects as lines of '{_ROTATED_LINE}'.", "find the {target}."),
    ("det_hbox", "json"): (None, "Locate every item of these categories and answer in JSON: {target}."),
    ("det_hbox", "plain"): (f"Answer with detections as lines of '{_BOX_LINE}'.", "find the {target}."),
}

#: name pattern -> (family, column the prompt asks about)
FAMILIES: list[tuple[str, str, str]] = [
    (r"(refcoco\w*_val|refgta_subsample|dior_rsvg_val|rsvg_val|vrsbench_referring)", "rec", "normal_caption"), (r"geoground.*", "rec", "question"), (r"geochat_referring", "referring", "question"),
    (r"geochat_region_captioning", "region_caption", "question"), (r"(vrsbench_caption|cap_\w+|geochat_grounding_description)", "caption", "question"), (r"(vrsbench_vqa|geochat_hrben|geochat_lrben)", "vqa", "question"),
    (r"(cls_\w+|geochat_aid|geochat_ucmerced)", "cls", "classes"), (r"(mme_realworld_remote_sensing|lrsvqa|vhm|teochatlas)\w*", "qa", "question"), (r"dota\w*", "det_qbox", "categories"), (r"res_rrsisd_\w+", "rec", "description"),
]


def family(benchmark: str) -> tuple[str, str]:
    """(family, target column) of a benchmark; an unknown name is an error."""
    for pattern, fam, column in FAMILIES:
        if re.fullmatch(pattern, benchmark):
            return fam, column
    raise ValueError(f"Unknown benchmark {benchmark}")


def check_benchmark(name: str) -> tuple[str, int, bool]:
    """(clean name, shots, unique) of ``name[_unique]_k``."""
    m = re.fullmatch(r"(.*?)(_unique)?_(\d+)", name)
    return (m[1], int(m[3]), m[2] is not None) if m else (name, 0, False)


def geoground_name(name: str) -> tuple[str, int | None]:
    """(dataset, resize) of ``geoground_<dataset>[_336|_224|_448|_1008]`` (P25, B1)."""
    m = re.fullmatch(r"(.*?)_(336|224|448|1008)(.*)", name)
    base = (m[1] + m[3]) if m else name
    return base.removeprefix("geoground_"), int(m[2]) if m else None


def _message(role: str, text: Column, image: Column | None = None) -> Column:
    part = lambda kind, t, m: F.struct(F.lit(kind).alias("type"), t.alias("text"), m.alias("media"))
    none = F.lit(None).cast("string")
    parts = [part("image", none, F.concat(F.lit("file://"), image))] if image is not None else []
    return F.struct(F.lit(role).alias("role"), F.array(*parts, part("text", text, none)).alias("content"))


def build_prompts(df: DataFrame, fam: str, target: Column, image: Column, prompt_type: str = "json", prefix: Column | None = None) -> DataFrame:
    """Column message: what is asked of the model (P21-P29); ``prefix`` holds in-context messages that go before."""
    key = (fam, "") if (fam, "") in PROMPTS else (fam, prompt_type)
    if key not in PROMPTS:
        raise ValueError(f"Unknown grounding prompt type: {prompt_type}")
    system, user = PROMPTS[key]
    before, after = user.split("{target}")
    turns = ([_message("system", F.lit(system))] if system else []) + [_message("user", F.concat(F.lit(before), target.cast("string"), F.lit(after)), image)]
    message = F.array(*turns)
    return df.withColumn("message", F.concat(prefix, message) if prefix is not None else message)


def prepare(df: DataFrame, benchmark: str, root: str, image: str = "image_id", prompt_type: str = "json", det_box: str = "qbox", prefix: Column | None = None) -> DataFrame:
    """Rows of a benchmark with their message; the caller numbers them with ``with_dense_index`` in an order of its choice."""
    clean, _, _ = check_benchmark(benchmark)
    if clean.startswith("geoground"):
        clean = "geoground_" + geoground_name(benchmark)[0]
    fam, column = family(clean)
    fam = f"det_{det_box}" if fam.startswith("det_") else fam
    return build_prompts(df, fam, F.col(column), F.concat_ws("/", F.lit(root.rstrip("/")), F.col(image)), prompt_type, prefix)


def detection_matrix(df: DataFrame, benchmark: str, root: str, boxes: tuple[str, ...] = ("hbox", "rbox", "qbox"), prompt_types: tuple[str, ...] = ("json", "plain"), instances: str | None = None) -> DataFrame:
    """Rows of a detection benchmark for each form of box and of prompt (P29), in columns det_box and prompt_type; by falling number of
    ``instances``, if there is such a column, so that the longest answers come first."""
    every = [prepare(df, benchmark, root, prompt_type=p, det_box=b).withColumns({"det_box": F.lit(b), "prompt_type": F.lit(p)}) for b in boxes for p in prompt_types]
    out = reduce(DataFrame.unionByName, every)
    return out.orderBy(F.desc(instances), "image_id", "det_box", "prompt_type") if instances else out


def check_prompt_type(candidates: DataFrame, prompt_type: str, text: str = "instruction") -> None:
    """Ranked in-context candidates must have been scored with the prompts of this run (F12): an error if one speaks of JSON where plain text
    is asked for, or the other way round."""
    is_json = F.contains(F.lower(text), F.lit("json"))
    if candidates.where(is_json != F.lit(prompt_type == "json")).select(F.lit(1)).first():
        raise ValueError(f"the candidates were not ranked with prompts of type {prompt_type}")


def as_list(gt: Column) -> Column:
    """Captions are judged against a list."""
    return F.array(gt)


# --- rows into training formats ------------------------------------------------------------------------------------


def question_of(conv: Column) -> Column:
    return X.strip(F.replace(conv[0]["value"], F.lit("<image>\n"), F.lit("")))


def format_conversations(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Conversations of image, question and answer as (image_id, type, question, ground_truth, solution, normal_caption, question_id), the
    first of each (type, image, question, answer) (P32, W3, X14)."""
    q, a = question_of(F.col("conversations")), F.col("conversations")[1]["value"]
    kind = X.detect_task(q, X.strip(a))
    numbers = F.transform(F.regexp_extract_all(a, F.lit(r"<(\d+)>"), F.lit(1)), lambda v: v.cast("int"))
    caption = F.regexp_extract(q, r"<p>(.*?)</p>", 1)
    caption = F.when(F.startswith(F.lower(caption), F.lit("the ")), X.strip(F.substring(caption, 5, 1 << 20))).otherwise(caption)
    is_ref = F.col("type") == "referring"
    rows = df.select(F.col("image").alias("image_id"), kind.alias("type"), q.alias("question"), a.alias("__a"), numbers.alias("__n"), caption.alias("__c"), F.col(idx).alias("question_id"))
    from .curation import dedup_keep_first

    key = F.when(is_ref, F.array_join(F.transform("__n", lambda v: v.cast("string")), ",")).otherwise(F.lower("__a"))
    rows = dedup_keep_first(rows.withColumns({"__key": key, "__q": F.lower("question")}), ["type", "image_id", "__q", "__key"], ["question_id"])
    return rows.select("image_id", "type", "question", F.when(~is_ref, F.array("__a")).alias("ground_truth"), F.when(is_ref, F.col("__n")).alias("solution"), F.when(is_ref, F.col("__c")).alias("normal_caption"), "question_id")


def format_captions(images: DataFrame, dataset: str) -> DataFrame:
    """(image_id, question, dataset, type, ground_truth, split) of images with their sentences."""
    return images.select(F.col("filename").alias("image_id"), F.lit("Describe the image").alias("question"), F.lit(dataset).alias("dataset"), F.lit("caption").alias("type"), F.transform("sentences", lambda s: X.strip(s["raw"])).alias("ground_truth"), "split")


def format_raw_captions(rows: DataFrame, dataset: str) -> DataFrame:
    """The same of (category, item map): the values of each key that starts with raw."""
    raw = F.map_filter("item", lambda k, v: F.startswith(k, F.lit("raw")))
    return rows.select(F.concat_ws("/", "category", F.col("item")["filename"]).alias("image_id"), F.lit("Describe the image").alias("question"), F.lit(dataset).alias("dataset"), F.lit("caption").alias("type"), F.transform(F.map_values(raw), lambda v: X.strip(v)).alias("ground_truth"), F.col("item")["split"].alias("split"))


def format_classes(df: DataFrame, dataset: str) -> DataFrame:
    """(image_id, ground_truth, dataset, type, split, classes): the class is the folder; all classes, sorted, in a string."""
    name = F.split("image_id", "/")[0]
    classes = df.select(name.alias("c")).distinct().agg(F.concat(F.array_join(F.array_sort(F.collect_list("c")), ","), F.lit(".")).alias("classes"))
    return df.select("image_id", name.alias("ground_truth"), F.lit(dataset).alias("dataset"), F.lit("cls").alias("type"), "split").crossJoin(F.broadcast(classes))  # one row


def format_geochat(df: DataFrame, task: str, ext: str = ".png") -> DataFrame:
    """Renamed and cleaned rows (P30, X19): cap, reg_cap, ref, cls, vqa."""
    stem = F.concat(F.split("image_id" if "image_id" in df.columns else "image", r"\.")[0], F.lit(ext))
    if task == "cap":
        return df.select(stem.alias("image_id"), F.lit("Describe the image").alias("question"), F.col("description").alias("ground_truth"), F.lit("caption").alias("type"), "question_id")
    if task == "reg_cap":
        return df.withColumn("image_id", F.concat("image_id", F.lit(ext)))
    if task == "ref":
        return df.withColumn("image_id", stem)
    if task == "cls":
        gt = F.lower(F.when(F.col("ground_truth") == "MediumResidentialgt", "medium residential").otherwise(F.col("ground_truth")))
        return df.select(stem.alias("image_id"), F.lower(X.strip(F.split(F.split("text", "Classes:")[1], "\n")[0])).alias("classes"), gt.alias("ground_truth"), F.lit("cls").alias("type"), "question_id")
    if task == "vqa":
        return df.select(F.col("image").alias("image_id"), F.lower(X.strip(F.split("text", "\n")[0])).alias("question"), F.lower("answer").alias("ground_truth"), "category", F.lit("vqa").alias("type"), "question_id")
    raise ValueError(f"Unknown task {task}")


# --- metrics -------------------------------------------------------------------------------------------------------


def tidy(df: DataFrame, by: Column | None = None, names: list[str] | None = None, n: str | None = "n") -> DataFrame:
    """(metric, value, n) of a wide result; ``by`` is put before a name."""
    cols = names or [c for c, t in df.dtypes if t == "double"]
    count = F.col(n).cast("bigint") if n in df.columns else F.lit(None).cast("bigint")
    name = lambda c: F.concat_ws("_", by, F.lit(c)) if by is not None else F.lit(c)
    return df.select(F.explode(F.array(*[F.struct(name(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"), count.alias("n")) for c in cols])).alias("m")).select("m.*")


def with_synonyms(df: DataFrame, synsets: DataFrame | None, pred: str = "output", gt: str = "ground_truth") -> Column | tuple[DataFrame, Column]:
    """(rows, whether an answer is equal to the truth or shares a synset with it) (A4, J11). synsets: (lemma, synset)."""
    p, g = X.norm(F.col(pred)), X.norm(F.col(gt))
    if synsets is None:
        return df, p == g
    table = synsets.groupBy(F.lower("lemma").alias("__lemma")).agg(F.collect_set("synset").alias("__syn"))
    rows = df.withColumns({"__p": p, "__g": g})
    for c in ("p", "g"):
        rows = join_checked(rows, table.withColumnsRenamed({"__lemma": f"__l{c}", "__syn": f"__s{c}"}), F.col(f"__{c}") == F.col(f"__l{c}"), "left", 200)
    return rows, (F.col("__p") == F.col("__g")) | F.coalesce(F.arrays_overlap("__sp", "__sg"), F.lit(False))


def rec_scores(df: DataFrame, prompt_type: str = "json", by: str | None = None) -> DataFrame:
    """acc@0.5 in percent (A5, A6): the answer's first box, in the size of the original image, against solution, or against
    normalized_solution if it was normalised (B18)."""
    b = X.parse_box(F.col("output"), prompt_type)
    box = G.rescale_box(b["box"], F.col("resized_width"), F.col("resized_height"), F.col("original_width"), F.col("original_height"))
    truth = F.when(b["normalized"], F.col("normalized_solution")).otherwise(F.col("solution"))
    df = df.select(*([by] if by else []), X.let(box, lambda p: X.let(truth, lambda t: F.coalesce(G.box_iou(p, t) > 0.5, F.lit(False)))).alias("ok"))
    ok = F.col("ok")
    g = df.groupBy(*([by] if by else [])).agg((M.accuracy(ok) * 100).alias("acc@0.5"), F.count("*").alias("n"))
    return tidy(g, F.col(by) if by else None)


def contain_scores(df: DataFrame) -> DataFrame:
    return tidy(df.agg(M.accuracy(M.contained(F.col("output"), F.col("ground_truth"))).alias("acc"), F.count("*").alias("n")))


def cider_scores(df: DataFrame, key: str = "idx") -> DataFrame:
    return tidy(M.cider(df, key, "output", "ground_truth").agg((F.avg("cider") * 100).alias("CIDEr"), F.count("*").alias("n")))


def referring_scores(df: DataFrame, prompt_type: str = "json") -> DataFrame:
    """Share of rows whose objects are all found and no others, over all and by size, type and count (A8). Boxes of 4 numbers and
    quadrangles of 8, or of 4 points, may be mixed; of an answer in plain text, runs of 8 numbers and then of 4."""
    flat = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0)), lambda v: v.cast("double"))  # numbers of a list of any depth
    if prompt_type == "json":
        boxes = F.transform(F.from_json(X.strip_fence(F.col("output")), "array<struct<bbox_2d: string>>"), lambda b: flat(b["bbox_2d"]))
    else:
        boxes = F.transform(X.plain_boxes(F.col("output")), lambda b: b.cast("array<double>"))
    truth = F.col("ground_truth")
    if "array<array<array" in df.schema["ground_truth"].dataType.simpleString():  # corners as points
        truth = F.transform(truth, F.flatten)
    sx, sy = F.col("original_width") / F.col("resized_width"), F.col("original_height") / F.col("resized_height")
    scale = lambda bs: F.transform(bs, lambda b: F.transform(b, lambda v, i: v * F.when(i % 2 == 0, sx).otherwise(sy)))
    rows = df.withColumns({"ok": D.referring_ok(scale(boxes), scale(truth)), "count": F.when(F.size("obj_ids") == 1, "single").otherwise("multiple"), "size": F.coalesce("size_group", F.lit("unknown")), "type": F.coalesce("type", F.lit("unknown"))})
    g = M.grouping_sets_accuracy(rows, F.col("ok"), [[], ["size"], ["type"], ["count"]])
    name = F.coalesce(*[F.when(F.col(f"by_{c}") == 1, F.concat(F.lit(f"{c}_"), F.col(c))) for c in ("size", "type", "count")], F.lit("overall"))
    return g.select(name.alias("metric"), F.col("acc").alias("value"), "n")


def mme_scores(df: DataFrame) -> DataFrame:
    c = F.col("Category")
    return tidy(M.sliced_accuracy(df, M.contained(F.col("output"), F.col("ground_truth")), {k: c == k for k in ("count", "color", "position")}), n=None)


def lrsvqa_scores(df: DataFrame, synsets: DataFrame | None = None) -> DataFrame:
    """Accuracy over all, by source and by task, and the mean over tasks by source and over all."""
    rows, ok = with_synonyms(df.withColumn("source", F.regexp_extract("question_id", "^(FAIR|STAR|GLH)", 1)), synsets)
    rows = rows.withColumn("__ok", ok)
    g = M.grouping_sets_accuracy(rows, F.col("__ok"), [[], ["source"], ["category"]])
    name = F.when(F.col("by_source") == 1, F.concat(F.lit("source_"), F.col("source"))).when(F.col("by_category") == 1, F.concat(F.lit("task_"), F.col("category"))).otherwise("overall")
    macro = M.macro_accuracy(rows, F.col("__ok"), "source", "category").select(F.when(F.col("is_source") == 1, F.concat(F.lit("average_source_"), F.col("source"))).otherwise("average").alias("metric"), F.col("macro_acc").alias("value"), F.col("n_tasks").alias("n"))
    return g.select(name.alias("metric"), F.col("acc").alias("value"), "n").unionByName(macro)


#: folder pattern -> (kind of answer, metric name; None: the folder's)
VHM_RULES: list[tuple[str, str, str | None]] = [
    (r"presence_mo_dota", "presence", "presence_acc"), (r"color_.*", "color", "color_acc"), (r"abspos_.*", "choice", "abspos_position_acc"), (r"relpos_.*", "choice", "relpos_position_acc"), (r"imgType_mcq", "choice", "modality_acc"),
    (r"counting_.*", "count", "counting"), (r"gsd_.*", "numbers", "resolution"), (r"obj_meas_.*", "numbers", "geometric"), (r"cls.*", "contain", None), (r"(?i)rsvqa.*", "contain", None),
]


def vhm_scores(df: DataFrame, folder: str = "image_path") -> DataFrame:
    """(metric, value, n) by the kind of answer that a folder's name stands for (A9, A22). Counting and measuring give a mean
    absolute and a mean relative error; pairs without a number, and relative errors of a zero truth, don't count (B15). Multi-label
    folders have no agreed score: their rows are counted as ``unsupported``; other folders are an error."""
    p, g, f = F.col("output"), F.col("ground_truth"), F.col(folder)
    pair = lambda e, t: F.array(F.struct(F.lit("mae").alias("s"), F.abs(e - t).alias("v")), F.struct(F.lit("mape").alias("s"), F.try_divide(F.abs(e - t), F.abs(t)).alias("v")))
    one = lambda v: F.array(F.struct(F.lit("").alias("s"), v.cast("double").alias("v")))
    values = {
        "presence": one(X.eval_presence(p, g)), "color": one(X.eval_color(p, g)), "choice": one(X.eval_choice(p, g)), "contain": one(X.eval_contain(p, g)),
        "count": pair(X.parse_number(X.norm(p)).cast("double"), F.coalesce(g.try_cast("double"), X.parse_number(X.norm(g)).cast("double"))),
        "numbers": F.flatten(F.transform(F.arrays_zip(X.decimals(p).alias("p"), X.decimals(g).alias("g")), lambda z: pair(z["p"], z["g"]))),
    }
    rule = reduce(lambda acc, r: F.when(F.rlike(f, F.lit(f"^(?:{r[0]})$")), F.struct(F.lit(r[1]).alias("k"), (F.lit(r[2]) if r[2] else f).alias("m"))).otherwise(acc), VHM_RULES[::-1], F.when(F.startswith(f, F.lit("mlc_")), F.struct(F.lit("none").alias("k"), F.lit("unsupported").alias("m"))).otherwise(F.raise_error(F.concat(F.lit("Unknown folder name: "), f))))
    rows = df.withColumn("__r", rule)
    scored = reduce(lambda acc, kv: F.when(F.col("__r.k") == kv[0], kv[1]).otherwise(acc), values.items(), one(F.lit(1.0)))
    rows = rows.select(F.col("__r.m").alias("m"), F.explode(scored).alias("x"))
    name = F.when(F.col("x.s") == "", F.col("m")).otherwise(F.concat_ws("_", "m", "x.s"))
    return rows.groupBy(name.alias("metric")).agg(F.when(F.first("m") == "unsupported", F.lit(None)).otherwise(F.avg("x.v")).cast("double").alias("value"), F.count("x.v").alias("n"))


_GRID = ["yes", "no", *[f"{v} {h}" if v != h else v for v in ("top", "center", "bottom") for h in ("left", "center", "right")]]
_DAMAGE = ["no damage", *(f"{x} damage" for x in ("minor", "major")), "destroyed"]
_URBAN = "residential|commercial|industrial|road|demolition|mega projects".split("|")
_STAGES = "prior construction|greenland|land cleared|excavation|materials dumped|construction started|construction midway|construction done|operational".split("|")
#: (dataset pattern, task pattern) -> (kind, classes, skipped classes, which value)
TEO_RULES: list[tuple[str, str, str, list[str], list[str], str]] = [
    (r"xbd_dmg_cls", "change_detection_classification", "area", _DAMAGE, ["unclassified"], "inv_w_f1"), (r"xbd_loc|s2_det", "change_detection_(localization|detection)", "mask", [], [], "f1"), (r"(xbd_sre_qa_rqa|s2_sre_qa)", "spatial_referring_expression", "mask", [], [], "f1"),
    (r"xbd_sre_qa_rqa", "question_answering", "keyword", _GRID, [], ""), (r"qfabric_rqa2|qfabric_rqa5_rtqa5", "region_based_question_answering", "area", _URBAN, [], "w_f1"), (r"qfabric_rqa5_rtqa5", "region_based_temporal_question_answering", "area", _STAGES, [], "w_f1"),
    (r"fmow_high_res|fmow_low_res|abcd|cdvqa|aid|ucmerced|lrben|hrben|xbd_sre_qa_rqa|s2_rqa|s2_sre_qa|qfabric_tre_rtqa", ".*", "accuracy", [], [], ""),
]


def wkt_rings(x: Column) -> Column:
    """array<array<double>>: the outer rings of a WKT polygon or multipolygon."""
    rings = F.regexp_extract_all(x, F.lit(r"\(\(([^()]+)\)"), F.lit(1))
    return F.transform(rings, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"), F.lit(0)), lambda v: v.cast("double")))


def answer_masks(x: Column, height: int = 256, width: int = 256) -> Column:
    """Polygons of the percentage boxes in an answer."""
    return F.transform(F.filter(X.int_boxes(x), lambda b: F.size(b) == 4), lambda b: F.transform(F.array(*[b[k] for k in (0, 1, 0, 3, 2, 3, 2, 1)]), lambda v, i: v / 100 * F.when(i % 2 == 0, F.lit(float(width))).otherwise(F.lit(float(height)))))


def mask_f1(df: DataFrame, height: int = 256, width: int = 256) -> DataFrame:
    """One row (precision, recall, f1, iou) of answered against true masks (A12i): pixel counts a row, then sums."""
    none = F.array().cast("array<array<double>>")
    truth = F.when(F.contains("ground_truth", F.lit("[")), wkt_rings(F.col("polygon"))).otherwise(none)
    c = df.select(G.mask_counts(answer_masks(F.col("output"), height, width), F.coalesce(truth, none), height, width).alias("c"))
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    conf = c.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gt"), F.lit(p).alias("pred"), F.col(f"c.{k}").alias("n")) for g, p, k in cells])).alias("e")).select("e.*").groupBy("gt", "pred").agg(F.sum("n").alias("n"))
    return M.binary_scores(conf)


def teochatlas_scores(df: DataFrame) -> DataFrame:
    """(metric, value, n), metric being <dataset>_<task>_<accuracy|f1> (A14, A10, A13). Needs dataset, task, output, ground_truth and,
    for areas and masks, polygon as WKT. A pair of dataset and task without a rule is an error.

    After a look at the names, one pass: the first rule that fits is a column, each row gives its share of the sums of its kind, and these are added up by
    dataset, task and class.
    """
    d, t, p, g = F.lower("dataset"), F.col("task"), X.clean_string(F.col("output")), X.clean_string(F.col("ground_truth"))
    fits = lambda r: F.rlike(d, F.lit(f"^(?:{r[0]})$")) & F.rlike(t, F.lit(f"^(?:{r[1]})$"))
    rule = reduce(lambda acc, kr: F.when(fits(kr[1]), F.lit(kr[0])).otherwise(acc), list(enumerate(TEO_RULES))[::-1], F.lit(None).cast("int"))
    if unknown := df.where(rule.isNull()).select(d.alias("d"), t.alias("t")).first():
        raise ValueError(f"Unsupported task {unknown['t']} for dataset {unknown['d']}")
    column = lambda k: F.element_at(F.array(*[F.array(*map(F.lit, r[k])).cast("array<string>") if isinstance(r[k], list) else F.lit(r[k]) for r in TEO_RULES]), F.col("r") + 1)
    rows = df.select(d.alias("d"), t.alias("t"), p.alias("p"), g.alias("g"), "output", "ground_truth", "polygon", rule.alias("r"))
    rows = rows.withColumns({"kind": column(2), "classes": column(3), "skip": column(4), "value": column(5)})
    none = F.array().cast("array<array<double>>")
    area, mask = F.col("kind") == "area", F.col("kind") == "mask"
    rings = F.coalesce(wkt_rings(F.col("polygon")), none)
    rows = rows.withColumn("m", G.mask_counts(F.when(area, rings).when(mask, answer_masks(F.col("output"))).otherwise(none), F.when(mask & F.contains("ground_truth", F.lit("[")), rings).otherwise(none)))
    zero, a, known = F.lit(0.0), F.col("m.fp").cast("double"), F.array_contains("classes", F.col("p"))
    part = lambda c, tp, fp, fn, n: F.struct(c.alias("class"), tp.cast("double").alias("tp"), fp.cast("double").alias("fp"), fn.cast("double").alias("fn"), n.cast("double").alias("n"))
    wrong = F.when(known & (F.col("p") != F.col("g")), a).otherwise(zero)
    areas = F.array(part(F.col("g"), F.when(F.col("p") == F.col("g"), a).otherwise(zero), zero, wrong, a), part(F.col("p"), zero, wrong, zero, zero))
    same = (F.col("p") == F.col("g")) | F.exists("classes", lambda k: F.contains("p", k) & F.contains("g", k))
    one = part(F.lit(""), F.coalesce(same, F.lit(False)).cast("int"), zero, zero, F.lit(1))
    parts = F.when(area & ~F.array_contains("skip", F.col("g")), areas).when(mask, F.array(part(F.lit(""), F.col("m.tp"), F.col("m.fp"), F.col("m.fn"), zero))).when(~area, F.array(one))
    sums = rows.select("d", "t", "r", F.explode(parts).alias("s")).groupBy("d", "t", "r", "s.class").agg(*[F.sum(f"s.{x}").alias(x) for x in ("tp", "fp", "fn", "n")])
    sums = sums.withColumns({"kind": column(2), "classes": column(3), "value": column(5)}).withColumn("total", F.sum("n").over(Window.partitionBy("d", "t", "r")))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)  # as of precision and recall, of which none is null with a hit
    own, share = F.array_contains("classes", F.col("class")), F.try_divide("n", "total")
    inverse = F.when(own & (share > 0), 1 / share)
    kind, value = F.first("kind"), F.first("value")
    by_kind = (
        F.when(kind == "mask", F.when(F.sum("tp") > 0, 2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))))
        .when(kind != "area", F.sum("tp") / F.sum("n")).when(value == "w_f1", F.sum(F.when(own, f1 * share)))
        .when(value == "inv_w_f1", F.coalesce(F.try_divide(F.sum(f1 * inverse), F.sum(inverse)), zero)).otherwise(F.sum(F.when(own, f1)) / F.first(F.size("classes")))
    )
    counted = kind.isin("keyword", "accuracy")
    return sums.groupBy("d", "t", "r").agg(by_kind.alias("v"), F.when(counted, F.sum("n").cast("bigint")).alias("n"), counted.alias("c")).select(F.concat_ws("_", "d", "t", F.when(F.col("c"), "accuracy").otherwise("f1")).alias("metric"), F.coalesce("v", F.when(~F.col("c"), zero)).alias("value"), "n")


def detection_scores(df: DataFrame, classes: list[str], prompt_type: str = "json", clear_for_empty: bool = False) -> DataFrame:
    """AP at IoU 0.5 by class, and their mean (A21), of answers with lists of instances against gt array<struct<poly, label>>, by the
    overlap of the quadrangles themselves; labels outside the classes become the best by weighted ratio (J12). Answers are blank
    where the truth is empty, if asked for (F9)."""
    inst = X.json_instances(F.col("output")) if prompt_type == "json" else X.plain_instances(F.col("output"))
    inst = F.when(F.lit(clear_for_empty) & (F.size("gt") == 0), F.array().cast("array<struct<poly: array<int>, label: string>>")).otherwise(inst)
    sx, sy = F.col("original_width") / F.col("resized_width"), F.col("original_height") / F.col("resized_height")
    scaled = F.transform(inst, lambda e: F.struct(F.transform(e["poly"], lambda v, i: v * F.when(i % 2 == 0, sx).otherwise(sy)).alias("poly"), e["label"].alias("label")))
    from .messages import weighted_labels

    pred = df.select("file_name", F.posexplode_outer(scaled).alias("k", "e")).where("e is not null").select("file_name", F.col("e.label").alias("label"), F.lit(1.0).alias("score"), F.col("k").cast("bigint").alias("ord"), F.col("e.poly").cast("array<double>").alias("box"), F.lit("pred").alias("kind"))
    pred = weighted_labels(pred, "label", classes).drop("label").withColumnRenamed("matched", "cls")
    truth = df.select("file_name", F.posexplode("gt").alias("k", "e")).select("file_name", F.col("e.label").alias("cls"), F.lit(None).cast("double").alias("score"), F.col("k").cast("bigint").alias("ord"), F.col("e.poly").cast("array<double>").alias("box"), F.lit("gt").alias("kind"))
    ap = D.average_precision(D.assign_detections(pred.unionByName(truth), "file_name", "cls", "score", "ord"), "cls", "score", "ord")
    return tidy(ap, F.col("cls"), ["ap"], "n_gt").unionByName(tidy(ap.agg(F.avg("ap").alias("mAP"), F.sum("n_gt").alias("n"))))


#: benchmark pattern -> metric
METRICS = [
    (r"(refcoco\w*_val|refgta_subsample|dior_rsvg_val|rsvg_val|vrsbench_referring)", rec_scores), (r"geoground.*", lambda df, **k: rec_scores(df, by="dataset_name", **k)), (r"geochat_referring", referring_scores),
    (r"(cls_\w+|vrsbench_vqa|geochat_(aid|ucmerced|hrben|lrben))", contain_scores), (r"(vrsbench_caption|cap_\w+|geochat_(region_captioning|grounding_description))", cider_scores),
    (r"mme_realworld_remote_sensing\w*", mme_scores), (r"lrsvqa\w*", lrsvqa_scores), (r"vhm\w*", vhm_scores), (r"teochatlas\w*", teochatlas_scores), (r"dota\w*", detection_scores),
]


def evaluate(df: DataFrame, benchmark: str, **options) -> DataFrame:
    """(metric, value, n) of a benchmark's answers."""
    clean, _, _ = check_benchmark(benchmark)
    for pattern, metric in METRICS:
        if re.fullmatch(pattern, clean):
            return metric(df, **options)
    raise NotImplementedError(f"Unknown benchmark: {benchmark}")

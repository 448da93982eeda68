"""Conversations in and out: roles, media tags, prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.geometry import resize_coords
from ..runtime import checkpoint, join_checked
from .ranking import mixed_key

MESSAGE = "array<struct<role: string, content: array<struct<type: string, text: string, media: string>>>>"


def ensure_image_tag(conv: Column, has_image: Column) -> Column:
    """<image> before the first human turn if a row has an image and no turn has a tag."""
    tagged = F.exists(conv, lambda c: F.contains(c["value"], F.lit("<image>")))
    first = F.array_position(F.transform(conv, lambda c: c["from"]), "human") - 1
    with_tag = F.transform(conv, lambda c, i: F.struct(c["from"].alias("from"), F.when(i == first, F.concat(F.lit("<image>\n"), c["value"])).otherwise(c["value"]).alias("value")))
    return F.when(has_image & ~tagged, with_tag).otherwise(conv)


def repair_roles(conv: Column) -> Column:
    """A turn without a speaker: the first is human, the others gpt (P20)."""
    return F.transform(conv, lambda c, i: F.struct(F.coalesce(c["from"], F.when(i == 0, "human").otherwise("gpt")).alias("from"), c["value"].alias("value")))


def to_messages(conv: Column, images: Column, videos: Column) -> Column:
    """array<struct<role, content array<struct<type, text, media>>>> (P11): human becomes user and gpt assistant; texts are cut at
    <image> and <video> tags, and the k-th tag of a kind takes the k-th file."""
    role = lambda c: F.when(c["from"] == "human", "user").when(c["from"] == "gpt", "assistant").otherwise(F.raise_error(F.concat(F.lit("Invalid role: "), c["from"])))
    clean = lambda v: T.strip(F.regexp_replace(v, r"(<image>|<video>)\n", "$1"))
    parts = lambda v: F.filter(F.split(clean(v), r"(?=<image>|<video>)|(?<=<image>|<video>)"), lambda p: T.strip(p) != "")
    count = lambda upto, tag: F.coalesce(F.aggregate(upto, F.lit(0), lambda a, c: a + F.size(F.regexp_extract_all(c["value"], F.lit(tag), F.lit(0)))), F.lit(0))

    def content(c: Column, i: Column) -> Column:
        ps = parts(c["value"])
        before = F.slice(conv, F.lit(1), i)
        nth = lambda p, j, tag: count(before, tag) + F.size(F.filter(F.slice(ps, F.lit(1), j), lambda q: q == tag))
        media = lambda p, j: F.when(p == "<image>", F.get(images, nth(p, j, "<image>"))).when(p == "<video>", F.get(videos, nth(p, j, "<video>")))
        kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
        return F.transform(ps, lambda p, j: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text"), media(p, j).alias("media")))

    return F.transform(conv, lambda c, i: F.struct(role(c).alias("role"), content(c, i).alias("content")))


def with_root(paths: Column, root: str) -> Column:
    """Files under an image folder."""
    return F.transform(paths, lambda p: F.concat_ws("/", F.lit(root.rstrip("/")), p))


def prefix_file_urls(url: Column, folder: str) -> Column:
    """file:// URLs under a folder."""
    return F.when(F.startswith(url, F.lit("file://")), F.concat(F.lit(f"file://{folder.rstrip('/')}/"), F.regexp_replace(url, "^file:///?", ""))).otherwise(url)


def choose_template(templates: list[str], id_col: str, seed: int = 42) -> Column:
    """One of the templates, by a seeded hash of the id."""
    return F.element_at(F.array(*map(F.lit, templates)), (F.pmod(mixed_key(id_col, seed), F.lit(len(templates))) + 1).cast("int"))


def detection_answer(anns: Column, box: str = "bbox", as_json: bool = True) -> Column:
    """Boxes by (rank, y1, x1), as fenced JSON or a line each; "There are none." without any."""
    key = "bbox_2d" if box == "bbox" else "quadrant bbox"
    order = F.array_sort(F.transform(anns, lambda a: F.struct(a["rank"].alias("r"), a["bbox"][1].alias("y"), a["bbox"][0].alias("x"), a[box].alias("b"), a["name"].alias("n"))))
    if as_json:
        item = lambda a: F.concat(F.lit(f'{{"{key}": ['), F.array_join(a["b"], ", "), F.lit('], "label": "'), a["n"], F.lit('"}'))
        body = F.concat(F.lit("```json\n[\n\t"), F.array_join(F.transform(order, item), ",\n\t"), F.lit("\n]\n```"))
    else:
        body = F.concat(F.array_join(F.transform(order, lambda a: F.concat_ws(" ", F.array_join(a["b"], ","), a["n"])), "\n"), F.lit("\n"))
    return F.when(F.size(anns) > 0, body).otherwise("There are none.")


def zoom_conversation(question: Column, answer: Column, crops: Column, enabled: bool = True) -> Column:
    """Five turns with a zoom when there is exactly one crop box, else question and answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    call = F.concat(F.lit('<tool_call>\n{"name": "zoom_in", "arguments": {"bbox_2d": ['), F.array_join(F.transform(F.get(crops, 0), lambda v: v.cast("int").cast("string")), ", "), F.lit("]}}\n</tool_call>"))
    zoom = F.array(
        turn("system", F.lit("You may zoom in before you answer.")), turn("user", F.concat(question, F.lit("\nFirst enlarge the region that matters, then answer."))), turn("assistant", call),
        turn("user", F.lit("This is the region, enlarged. Please finish the task.")), turn("assistant", answer),
    )
    return F.when(F.lit(enabled) & (F.size(crops) == 1), zoom).otherwise(F.array(turn("user", question), turn("assistant", answer)))


def choice_question(question: Column, choices: Column) -> Column:
    """Multiple choice prompt."""
    return F.concat(question, F.lit(" The choices are listed below:\n"), F.array_join(choices, "\n"), F.lit("\nAnswer with the letter of the right choice and nothing else.\nAnswer:"))


def coco_images(images: DataFrame, annotations: DataFrame, categories: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Images with their nested annotations, boxes as xyxy, categories normalised and ranked.

    Categories are a short list and are ranked in one task; annotations meet their images by one shuffle.
    """
    named = categories.select(F.col("id").alias("category_id"), F.lower(F.replace("name", F.lit("-"), F.lit(" "))).alias("name"))
    ranked = named.withColumn("rank", F.row_number().over(Window.orderBy("name", "category_id")) - 1)
    from ..functions.geometry import xywh_to_xyxy

    nested = annotations.join(ranked, "category_id").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("ann_id"), "name", xywh_to_xyxy(F.col("bbox")).alias("bbox")))).alias("annotations"))
    names = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda c: c["name"]), ", ").alias("categories"))
    out = images.join(nested, images["id"] == nested["image_id"], "left" if keep_empty else "inner").drop("image_id")
    empty = F.array().cast("array<struct<rank: int, ann_id: bigint, name: string, bbox: array<double>>>")
    return out.withColumn("annotations", F.coalesce("annotations", empty)).crossJoin(F.broadcast(names))  # one row


def resize_annotations(anns: Column, ow: Column, oh: Column, rw: Column, rh: Column) -> Column:
    return F.transform(anns, lambda a: a.withField("bbox", resize_coords(a["bbox"], ow, oh, rw, rh)))


def region_todo(df: DataFrame, idx: str, regions: list[str]) -> DataFrame:
    """A row for each region type (J8), in the order of ``regions`` (O2)."""
    return df.select("*", F.posexplode(F.array(*map(F.lit, regions))).alias("region_order", "region_type"))


def clean_turns(q: Column, a: Column) -> Column:
    """Struct (value, ori_value): boxes that merely repeat the question's are taken out of the answer."""
    same = F.coalesce(T.same_boxes(q, a), F.lit(False))
    return F.struct(F.when(same, T.remove_boxes(a)).otherwise(a).alias("value"), F.when(same, a).alias("ori_value"))


def pred_with_truth(pred: DataFrame, truth: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Predictions with the truth's columns where there is one."""
    t = truth.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = pred.join(t, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) if c in pred.columns else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def answers_by_position(questions: DataFrame, answers: Column, position: str) -> DataFrame:
    """Questions with the answer at their 0-based place in a list."""
    return questions.withColumn("answer", F.get(answers, F.col(position).cast("int")))


def fuzzy_labels(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Column matched: the label if it is a class, else the class of least edit distance, the first by name among equals (J12). The
    classes are a driver-side list, compared within the row."""
    names = F.array(*[F.lit(c) for c in sorted(classes)])
    best = F.array_min(F.transform(names, lambda c: F.struct(F.levenshtein(F.col(label), c).alias("d"), c.alias("c"))))["c"]
    return df.withColumn("matched", F.when(F.array_contains(names, F.col(label)), F.col(label)).otherwise(best))


def weighted_labels(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """As ``fuzzy_labels``, by weighted ratio: the first of the classes, as given, with the best one (J12). Each different label that isn't a
    class is compared once; null and empty labels have none."""
    order = list(dict.fromkeys(classes))

    @F.pandas_udf(StringType())
    def best(labels: pd.Series) -> pd.Series:
        return pd.Series([max(order, key=lambda c: T.weighted_ratio(x, c), default=None) if x else None for x in labels], dtype="object")

    odd = df.where(F.col(label).isNotNull() & ~F.col(label).isin(order)).select(F.col(label).alias("__odd")).distinct()
    known = checkpoint(odd.withColumn("__best", best("__odd")))
    out = join_checked(df, known, F.col(label) == F.col("__odd"), "left", 100)
    return out.withColumn("matched", F.when(F.col(label).isin(order), F.col(label)).otherwise(F.col("__best"))).drop("__odd", "__best")


def class_vector(x: Column, classes: list[str]) -> Column:
    """1 for each class that the text names."""
    return F.array(*[F.contains(x, F.lit(c)).cast("int") for c in classes])


def refer_filter(refs: DataFrame, split: str) -> DataFrame:
    """Split semantics of referring data (F4): testA, testB, testC by their letter, test by containing it, others equal."""
    col = F.col("split")
    if split in ("testA", "testB", "testC"):
        return refs.where(F.contains(col, F.lit(split[-1])))
    return refs.where(F.contains(col, F.lit("test"))) if split == "test" else refs.where(col == split)


def refer_sentences(refs: DataFrame, annotations: DataFrame, images: DataFrame) -> DataFrame:
    """A row for each sentence with its reference, box and image."""
    s = refs.select("ref_id", "ann_id", "image_id", "split", F.explode("sentences").alias("s")).select("ref_id", "ann_id", "image_id", "split", "s.sent_id", "s.sent")
    return s.join(annotations.select(F.col("id").alias("ann_id"), "bbox"), "ann_id").join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")

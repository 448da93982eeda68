"""Training samples of regions: a row for each region type, its conversation, and the media settings of a message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..runtime import join_checked
from .messages import region_todo
from .ranking import mixed_key

#: dataset type -> region types (E1); a new type is a row here.
REGION_TYPES: dict[str, list[str]] = {
    "dense_det": ["hbb", "obb", "polygon"], "dense_det_hbb_only": ["hbb"], "dense_det_obb_only": ["obb"], "dense_det_polygon_only": ["polygon"],
    "refgeo": ["hbb", "obb", "polygon", "seg"], "refgeo_hbb_only": ["hbb"], "refgeo_obb_only": ["obb"], "refgeo_polygon_only": ["polygon"], "refgeo_seg_only": ["seg"],
}
_KEYS = {"hbb": "bbox_2d", "obb": "oriented bbox", "polygon": "quadrant bbox"}


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from a seeded hash of the id: the random choices of sample builders, repeatable."""
    return F.pmod(mixed_key(id_col, seed), F.lit(1_000_000)) / F.lit(1_000_000.0)


def samples(df: DataFrame, idx: str, dataset_type: str, masks: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """A row for each region type of a dataset's rows, in order (J8, O2, P14); seg rows only where ``masks`` lists the image, or where
    mask_exists says so (F2)."""
    todo = region_todo(df, idx, REGION_TYPES[dataset_type])
    if "seg" not in REGION_TYPES[dataset_type]:
        return todo
    if masks is None:
        return todo.where((F.col("region_type") != "seg") | F.col("mask_exists"))
    listed = masks.select(F.col(image).alias("__m")).distinct().withColumn("__has", F.lit(True))
    out = join_checked(todo, listed, F.col(image) == F.col("__m"), "left", 64)
    return out.where((F.col("region_type") != "seg") | F.col("__has")).drop("__m", "__has")


def coords_of(region: Column, bbox: Column, poly: Column, clockwise: bool = True) -> Column:
    """array<int> of a region: its box, its least rectangle, or its canonical corners."""
    quad = G.normalize_polygon(poly.cast("array<double>"), clockwise).cast("array<int>")
    return F.when(region == "hbb", bbox.cast("array<int>")).when(region == "obb", G.min_area_rect(F.when(region == "obb", poly.cast("array<double>")))).when(region == "polygon", quad)


def region_answer(region: Column, coords: Column, label: Column, as_json: Column) -> Column:
    """The coordinates as fenced JSON, or as a line."""
    key = F.create_map(*[F.lit(x) for kv in _KEYS.items() for x in kv])
    js = F.concat(F.lit('```json\n[\n\t{"'), F.try_element_at(key, region), F.lit('": ['), F.array_join(coords.cast("array<string>"), ", "), F.lit('], "label": "'), label, F.lit('"}\n]\n```'))
    return F.when(as_json, js).otherwise(F.concat(F.concat_ws(" ", F.array_join(coords.cast("array<string>"), ","), label), F.lit("\n")))


def mask_answer(mask: Column, height: int, width: int, close: int = 50, cell: int = 28) -> Column:
    """Run lengths of a mask that is closed, filled, resized and max-pooled."""

    @F.pandas_udf("array<array<int>>")
    def pooled(masks: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for m in masks:
            if m is None:
                out.append(None)
                continue
            x = G.close_mask_np(np.array([list(r) for r in m]) > 1, close)
            rows, cols = (np.minimum(np.arange(n) * s // n, s - 1) for n, s in ((height, x.shape[0]), (width, x.shape[1])))  # nearest
            out.append(G.max_pool_np(x[np.ix_(rows, cols)], cell).tolist())
        return pd.Series(out)

    return G.rle_rows(pooled(mask))


def open_ended(df: DataFrame, template: str, name: str, synonyms: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Templates without their list of categories, and names replaced by one of their synonyms (P10). synonyms: (name, synonym)."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"[_\-]+", " "))
    table = synonyms.groupBy(clean(F.col("name")).alias("__n")).agg(F.array_sort(F.collect_set("synonym")).alias("__s"))
    rows = join_checked(df.withColumn("__k", clean(F.col(name))), table, F.col("__k") == F.col("__n"), "left", 300)
    pick = F.element_at("__s", (F.pmod(mixed_key(id_col, seed), F.size("__s")) + 1).cast("int"))
    rows = rows.withColumn(name, F.when(F.size("__s") > 0, pick).otherwise(F.col(name)))
    return rows.withColumn(template, F.regexp_replace(template, r"(the )?\{categories\}", "all the visible remote sensing objects")).drop("__k", "__n", "__s")


def random_size(h: Column, w: Column, id_col: str, seed: int, low: float = 0.5, high: float = 1.5, probability: float = 1.0) -> Column:
    """Struct (h, w) scaled by a seeded factor in [low, high), with a probability, then made to fit."""
    k = F.when(uniform(id_col, seed + 1) < probability, low + uniform(id_col, seed) * (high - low)).otherwise(1.0)
    return G.smart_resize(h * k, w * k)


def with_vision_limits(message: Column, min_pixels: int, max_pixels: int, video_min: int | None = None, video_max: int | None = None) -> Column:
    """Messages whose media carry their pixel limits."""
    lim = lambda kind, a, b: F.when(kind == "image", F.lit(a)).when(kind == "video", F.lit(b)).cast("bigint")
    part = lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["media"].alias("media"), lim(p["type"], min_pixels, video_min).alias("min_pixels"), lim(p["type"], max_pixels, video_max).alias("max_pixels"))
    return F.transform(message, lambda m: F.struct(m["role"].alias("role"), F.transform(m["content"], part).alias("content")))


def media_of(df: DataFrame, idx: str, message: str = "message") -> DataFrame:
    """(idx, turn, place, type, media): the media of each row's messages, to be fetched."""
    turns = df.select(idx, F.posexplode(message).alias("turn", "m")).select(idx, "turn", F.posexplode("m.content").alias("place", "p"))
    return turns.where("p.type <> 'text'").select(idx, "turn", "place", "p.type", "p.media")


def data_url(content: Column, kind: str = "png") -> Column:
    """Inline image of a request."""
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))


def add_to_last_user_text(message: Column, suffix: str) -> Column:
    """A suffix on the last text of the last user turn."""
    last = lambda xs, ok: F.array_max(F.transform(xs, lambda x, i: F.when(ok(x), i).otherwise(-1)))
    turn = last(message, lambda m: m["role"] == "user")

    def one(m: Column, i: Column) -> Column:
        place = last(m["content"], lambda p: p["type"] == "text")
        content = F.transform(m["content"], lambda p, j: p.withField("text", F.when((i == turn) & (j == place), F.concat(p["text"], F.lit(suffix))).otherwise(p["text"])))
        return m.withField("content", content)

    return F.transform(message, one)


def expand_vision_pads(text: Column, counts: Column, pad: str = "<pad>") -> Column:
    """The k-th placeholder becomes counts[k] of them."""
    parts = F.split(text, pad.replace("|", r"\|"))
    return F.array_join(F.transform(parts, lambda s, i: F.concat(s, F.when(i < F.size(parts) - 1, F.repeat(F.lit(pad), F.coalesce(F.get(counts, i), F.lit(1)))).otherwise(F.lit("")))), "")


def ordered_pick(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of a list of keys, in its order (J7). The list comes from the driver."""
    kind = df.schema[key].dataType.simpleString()
    order = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"__k {kind}, pos int")
    return df.join(F.broadcast(order), F.col(key) == F.col("__k")).drop("__k").orderBy("pos")  # as long as the list


def flatten_coords(x: Column) -> Column:
    """array<array<array<double>>> as array<array<double>>."""
    return F.transform(x, lambda b: F.flatten(b))

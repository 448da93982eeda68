"""Fetching media where they are: files of a shared mount, the web, or inline data; failures are values, not errors."""

from __future__ import annotations

import base64
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError, URLError
from urllib.parse import unquote, urlparse
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .readers import image_size

FETCHED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def content_of(url: str, timeout: float = 20.0, tries: int = 3) -> bytes:
    """Bytes of http(s)://, file://, a path, or a data URL (S10). The web is asked again after errors that may pass."""
    if url.startswith("data:"):
        head, _, body = url.partition(",")
        return base64.b64decode(body, validate=True) if head.endswith(";base64") else unquote(body).encode()
    if url.startswith(("http://", "https://")):
        for k in range(tries):
            try:
                with urlopen(Request(url, headers={"User-Agent": "vellumkit"}), timeout=timeout) as r:
                    return r.read()
            except HTTPError as e:
                if e.code < 500 and e.code != 429 or k == tries - 1:
                    raise
            except (URLError, TimeoutError):
                if k == tries - 1:
                    raise
            time.sleep(0.2 * 2**k)
    with open(unquote(urlparse(url).path) if url.startswith("file://") else url, "rb") as f:
        return f.read()


def fetched(url: Column, timeout: float = 20.0, threads: int = 8) -> Column:
    """Struct (content, error) of each URL (S10): a batch is fetched by a few threads, each URL of it once. A null URL gives nulls."""

    @F.pandas_udf(FETCHED)
    def fetch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(u: str) -> tuple[bytes | None, str | None]:
            try:
                return content_of(u, timeout), None
            except Exception as e:  # any failure belongs to its row
                return None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(threads) as pool:
            for urls in batches:
                known = list({u for u in urls if u is not None})
                got = dict(zip(known, pool.map(one, known))) | {None: (None, None)}
                yield pd.DataFrame([got[u if isinstance(u, str) else None] for u in urls], columns=["content", "error"])

    return fetch(url)


def vision_batch(df: DataFrame, idx: str, message: str = "message", fps: float = 2.0) -> DataFrame:
    """(idx, images, videos, sizes, video_kwargs) of each row's messages, in order (S12): the media with their bytes, the pictures' (height,
    width) from their headers, and the frames a second of each video. Rows without media have empty lists."""
    parts = df.select(idx, F.posexplode(message).alias("turn", "m")).select(idx, "turn", F.posexplode("m.content").alias("place", "p")).where("p.type <> 'text'")
    parts = parts.select(idx, "turn", "place", F.col("p.type").alias("type"), F.col("p.media").alias("media"), fetched(F.col("p.media")).alias("f"))
    parts = parts.withColumn("size", image_size(F.col("f.content")))
    item = F.struct("turn", "place", "media", F.col("f.content").alias("content"), F.col("f.error").alias("error"), F.struct("size.height", "size.width").alias("size"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, item)))
    every = df.select(idx).distinct().join(parts.groupBy(idx).agg(of("image").alias("i"), of("video").alias("v")), idx, "left")
    media = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x["media"].alias("media"), x["content"].alias("content"), x["error"].alias("error"))), F.array().cast("array<struct<media: string, content: binary, error: string>>"))
    sizes = F.coalesce(F.transform("i", lambda x: x["size"]), F.array().cast("array<struct<height: int, width: int>>"))
    return every.select(idx, media("i").alias("images"), media("v").alias("videos"), sizes.alias("sizes"), F.struct(F.transform(media("v"), lambda _: F.lit(fps)).alias("fps")).alias("video_kwargs"))

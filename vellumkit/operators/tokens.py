"""Messages to token ids and labels: spans by higher-order functions, ids by an Arrow UDF over a tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .packing import mask_labels

START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "You are a helpful assistant."
PADS = {"image": ("<|vision_start|>", "<|image_pad|>", "<|vision_end|>"), "video": ("<|vision_start|>", "<|video_pad|>", "<|vision_end|>")}


def _span(text: Column, label: Column) -> Column:
    return F.struct(text.alias("text"), label.alias("is_label"))


def chat_spans(message: Column, media_tokens: Column) -> Column:
    """array<struct<text, is_label>> of a conversation in chat form (P38): what the assistant says, and its end mark, are labels; a default
    system turn goes first if there is none; the k-th picture or video becomes media_tokens[k] pads; neighbours of a kind are merged."""
    no = F.lit(False)

    def is_media(p: Column) -> Column:
        return p["type"] != "text"

    def before(i: Column, j: Column) -> Column:  # media parts before part j of message i
        earlier = F.flatten(F.transform(F.slice(message, F.lit(1), i), lambda m: m["content"]))
        return F.size(F.filter(earlier, is_media)) + F.size(F.filter(F.slice(F.get(message, i)["content"], F.lit(1), j), is_media))

    def part(m: Column, i: Column, p: Column, j: Column) -> Column:
        pads = lambda kind: F.concat(F.lit(PADS[kind][0]), F.repeat(F.lit(PADS[kind][1]), F.coalesce(F.get(media_tokens, before(i, j)), F.lit(0))), F.lit(PADS[kind][2]))
        text = F.when(p["type"] == "image", pads("image")).when(p["type"] == "video", pads("video")).otherwise(p["text"])
        return _span(text, (p["type"] == "text") & (m["role"] == "assistant"))

    def turn(m: Column, i: Column) -> Column:
        head = _span(F.concat(F.lit(START), m["role"], F.lit("\n")), no)
        return F.concat(F.array(head), F.transform(m["content"], lambda p, j: part(m, i, p, j)), F.array(_span(F.lit(END), m["role"] == "assistant"), _span(F.lit("\n"), no)))

    turns = F.flatten(F.transform(message, turn))
    default = F.array(_span(F.lit(f"{START}system\n{SYSTEM}{END}\n"), no))
    spans = F.when(F.get(message, F.lit(0))["role"] == "system", turns).otherwise(F.concat(default, turns))
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(_span(F.concat(last(acc)["text"], s["text"]), s["is_label"])))
    merge = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["is_label"] == s["is_label"]), grown(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans, F.array().cast("array<struct<text: string, is_label: boolean>>"), merge)


def _sent(tokenizer_path: str):
    """The tokenizer's file, read on the driver, for the executors."""
    return SparkSession.active().sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))


def tokenize(df: DataFrame, spans: str, tokenizer_path: str) -> DataFrame:
    """Columns input_ids and labels (P38): each span is encoded by itself; ids outside the labels are ignored."""
    sent = _sent(tokenizer_path)

    @F.pandas_udf("ids array<int>, keep array<boolean>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(sent.value)
        for rows in batches:
            lists = [[] if r is None else [(s["text"] or "", bool(s["is_label"])) for s in r] for r in rows]
            encoded = iter(tok.encode_batch([t for x in lists for t, _ in x], add_special_tokens=False))
            out = []
            for x in lists:
                ids, keep = [], []
                for _, k in x:
                    e = next(encoded).ids
                    ids += e
                    keep += [k] * len(e)
                out.append((ids, keep))
            yield pd.DataFrame(out, columns=["ids", "keep"])

    e = df.withColumn("__e", encode(F.col(spans)))
    return e.withColumns({"input_ids": F.col("__e.ids"), "labels": mask_labels(F.col("__e.ids"), F.col("__e.keep"))}).drop("__e")


def sample_length(spans: Column, tokenizer_path: str) -> Column:
    """Number of tokens, without keeping them."""
    sent = _sent(tokenizer_path)

    @F.pandas_udf("int")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(sent.value)
        for rows in batches:
            yield pd.Series([0 if r is None else sum(len(e.ids) for e in tok.encode_batch([s["text"] or "" for s in r], add_special_tokens=False)) for r in rows], dtype="int32")

    return length(spans)

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vellumkit.operators import messages as S, tokens as T

FILE = "/opt/tokenizers/byte_bpe_50k.json"


def frame(spark):
    msg = [("user", [("image", None, "a.png"), ("text", "What is it?", None)]), ("assistant", [("text", "A dog", None)]), ("user", [("video", None, "v"), ("text", "sure?", None)]), ("assistant", [("text", "Yes", None)])]
    sys = [("system", [("text", "Be brief.", None)]), *msg[:2]]
    return spark.createDataFrame([(1, msg, [2, 3]), (2, sys, [1])], f"id int, m {S.MESSAGE}, n array<int>")


def test_spans(spark):
    got = {r["id"]: [tuple(s) for s in r["s"]] for r in frame(spark).select("id", T.chat_spans(F.col("m"), F.col("n")).alias("s")).collect()}
    a = got[1]
    assert [k for _, k in a] == [False, True, False, True, False]
    assert a[0][0] == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n<|vision_start|><|image_pad|><|image_pad|><|vision_end|>What is it?<|im_end|>\n<|im_start|>assistant\n"
    assert a[1] == ("A dog<|im_end|>", True) and a[2][0].count("<|video_pad|>") == 3 and a[4] == ("\n", False)
    assert got[2][0][0].startswith("<|im_start|>system\nBe brief.<|im_end|>")


@pytest.mark.skipif(not Path(FILE).exists(), reason="no tokenizer file")
def test_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    df = frame(spark).withColumn("s", T.chat_spans(F.col("m"), F.col("n")))
    for r in T.tokenize(df, "s", FILE).withColumn("len", T.sample_length(F.col("s"), FILE)).collect():
        want = [(i, k) for s in r["s"] for k in [s["is_label"]] for i in tok.encode(s["text"], add_special_tokens=False).ids]
        assert r["input_ids"] == [i for i, _ in want] and r["labels"] == [i if k else -100 for i, k in want] and r["len"] == len(want)

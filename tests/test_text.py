"""Golden cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from vellumkit.functions import text as X


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


L = F.lit


def test_norm(spark):
    assert one(spark, X.norm(L("\t A. \n"))) == "a"
    assert one(spark, X.norm(L(None).cast("string"))) is None


@pytest.mark.parametrize(
    "text,kind,box,flag",
    [
        ("[0.1, 0.2, 0.5, 0.6]", "json", [100, 200, 500, 600], True), ("none", "json", [0, 0, 0, 0], False), ("x [1, 2,3 , 4] y", "json", [1, 2, 3, 4], False),
        ("1,2,3,4 ship\nmore", "plain", [1, 2, 3, 4], False), ("see 1,2,3,4 ship", "plain", [0, 0, 0, 0], False), (None, "json", [0, 0, 0, 0], False),
    ],
)
def test_parse_box(spark, text, kind, box, flag):
    r = one(spark, X.parse_box(L(text).cast("string"), kind))
    assert r["box"] == box and r["normalized"] is flag


def test_boxes_in_text(spark):
    assert one(spark, X.denormalize_boxes(L("a [10, 20, 30, 40] b"), L(336), L(224))) == "a [33, 44, 100, 89] b"
    assert one(spark, X.denormalize_boxes(L("a [1, 2] b"), L(336), L(224))) == "a [1, 2] b"
    assert one(spark, X.remove_boxes(L("At [1, 2, 3, 4] tree"))) == "At tree"
    assert one(spark, X.are_all_boxes(L(" [1, 2,3,4], [5,6,7,8]."))) is True
    assert one(spark, X.are_all_boxes(L("at [1,2,3,4]"))) is False
    assert one(spark, X.plain_boxes(L("1,2,3,4 and 5,6,7,8"))) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert one(spark, X.grounding_answer(L("[1, 2, 3, 4]"), L("<video> Identify the location of the 3 buildings."))) == "1,2,3,4 the buildings\n"


def test_grounding_json(spark):
    out = one(spark, X.grounding_answer(L("[1, 2, 3, 4]"), L('Identify "x"'), as_json=True))
    assert one(spark, X.json_boxes(L(out)))[0]["label"] == '"x"'


@pytest.mark.parametrize("text,want", [("twenty-one cars", 21), ("twenty one", 20), ("about 12 of 30", 12), ("none", None), ("Ninety-nine", 99), ("zero", 0)])
def test_number(spark, text, want):
    assert one(spark, X.parse_number(L(text))) == want


def test_answers(spark):
    assert one(spark, X.eval_color(L("light red"), L("red, blue"))) == 0.5
    assert one(spark, X.eval_presence(L("Yes, there is none"), L("yes"))) is False
    assert one(spark, X.eval_choice(L("it is B"), L("b"))) is True
    assert one(spark, X.eval_choice(L("Answer: B"), L("b"))) is False
    assert one(spark, X.eval_choice(L("nothing"), L("b"))) is False


@pytest.mark.parametrize("text,want", [("Two dogs, a cat.", "2 dogs cat"), ("none", "0"), ("dont", "don't"), ("red/blue", "red blue"), ("red/ blue", "red blue"), ("3.5 m.", "3.5 m"), ("the man's hat", "man 's hat")])
def test_normalize_answer(spark, text, want):
    assert one(spark, X.normalize_answer(L(text))) == want


def test_soft_score_is_the_loop(spark):
    """The closed form against the definition: leave one human out, count the others that agree."""
    for k in range(11):
        answers = ["x"] * k + [f"y{i}" for i in range(10 - k)]
        want = sum(min(1, sum(a == "x" for j, a in enumerate(answers) if j != i) / 3) for i in range(10)) / 10 if k else 0.0
        assert one(spark, X.soft_vqa_score(L("x"), F.array(*map(L, answers)))) == pytest.approx(want)


def test_anls(spark):
    assert one(spark, X.anls(L(""), L(""))) == 1.0
    assert one(spark, X.anls(L("abcd"), L("abcx"))) == 0.75
    assert one(spark, X.anls(L("abcd"), L("wxyz"))) == 0.0


def test_repair(spark):
    bad = '```json\n[\n{"quadrant bbox": (1, 2, 3, 4, 5, 6, 7, 8), "label": "label": "Ship"},,\n{"quadrant bbox": [1 2\n]\n```'
    assert [(r["poly"], r["label"]) for r in one(spark, X.json_instances(L(bad)))] == [([1, 2, 3, 4, 5, 6, 7, 8], "ship")]
    good = '[{"quadrant bbox": [1,2,3,4,5,6,7,8,9], "label": "A"}, {"quadrant bbox": [1.5,2,3,4,5,6,7,8], "label": "B"}]'
    assert [(r["poly"], r["label"]) for r in one(spark, X.json_instances(L(good)))] == [([1, 2, 3, 4, 5, 6, 7, 8], "a")]
    assert one(spark, X.plain_instances(L("1,2,3,4,5,6,7,8 Big ship\nx y\n1,2 z")))[0]["label"] == "big ship"


def test_tool_call_and_thinking(spark):
    assert one(spark, X.tool_call_box(L('a <tool_call>{"name": "z", "arguments": {"bbox_2d": [1, 2, 3, 4]}}</tool_call>'))) == [1, 2, 3, 4]
    assert one(spark, X.tool_call_box(L("<tool_call>nonsense</tool_call>"))) is None
    assert tuple(one(spark, X.split_thinking(L("<think>a\nb</think> c")))) == ("a\nb", "c")
    assert tuple(one(spark, X.split_thinking(L("c")))) == (None, "c")


@pytest.mark.parametrize("q,a,want", [("where", "{<1><2><3><4>}", "referring"), ("Describe it", "x", "caption"), ("is it", "yes", "vqa")])
def test_task(spark, q, a, want):
    assert one(spark, X.detect_task(L(q), L(a))) == want


def test_names(spark):
    assert [one(spark, X.sampling_rate(L(s))) for s in ("x%50", "x*3", "x%0.5", "x")] == [0.5, 3.0, 0.005, 1.0]
    assert tuple(one(spark, X.benchmark_suffix(L("cls_aid_unique_4")))) == ("cls_aid", 4, True)
    assert tuple(one(spark, X.benchmark_suffix(L("geoground_336")))) == ("geoground", 336, False)
    assert tuple(one(spark, X.benchmark_suffix(L("plain")))) == ("plain", 0, False)

"""Answers and boxes out of free text, as column expressions (JVM-side, whole-stage codegen where Spark offers it)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

WS = " \t\n\r\f\x0b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BOX = r"\[(\d+(?:\s*,\s*\d+)*)\]"
FOUR = r"\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]"
NUMBER = r"-?\d*\.?\d+"
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = dict(zip(_ONES, range(20))) | {t + (f"-{_ONES[i]}" if i else ""): 20 + 10 * k + i for k, t in enumerate(_TENS) for i in range(10)}


def strip(x: Column, chars: str = WS) -> Column:
    """Trim any of ``chars`` at both ends (Spark's ``trim`` alone takes spaces only)."""
    return F.trim(x, F.lit(chars))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def norm(x: Column) -> Column:
    """Lower case, outer white space off, then outer full stops off."""
    return strip(strip(F.lower(x)), ".")


def clean_string(x: Column, ignore_casing: bool = True, ignore_punctuation: bool = True) -> Column:
    """Lower case without ASCII punctuation."""
    x = F.lower(x) if ignore_casing else x
    return F.translate(x, PUNCTUATION, "") if ignore_punctuation else x


def eval_contain(pred: Column, gt: Column) -> Column:
    """Either holds the other, normalised."""
    p, g = norm(pred), norm(gt)
    return F.contains(g, p) | F.contains(p, g)


def eval_presence(pred: Column, gt: Column) -> Column:
    """Yes/no answer against the truth; an answer with both, or neither, is unknown."""
    p = norm(pred)
    yes, no = F.contains(p, F.lit("yes")) | F.contains(p, F.lit("true")), F.contains(p, F.lit("no")) | F.contains(p, F.lit("false"))
    return F.when(yes & ~no, "yes").when(no & ~yes, "no").otherwise("unknown") == norm(gt)


def eval_color(pred: Column, gt: Column) -> Column:
    """Share of the true colours that the answer names."""
    p = F.replace(norm(pred), F.lit(" "), F.lit(""))
    colours = F.split(F.replace(norm(gt), F.lit(" "), F.lit("")), ",")
    return F.size(F.filter(colours, lambda c: F.contains(p, c))) / F.size(colours)


def eval_choice(pred: Column, gt: Column) -> Column:
    """The first capital A-E of the answer is in the truth; false without any."""
    letter = F.lower(F.regexp_extract(strip(strip(pred), "."), "[ABCDE]", 0))
    return (letter != "") & F.contains(norm(gt), letter)


def parse_number(x: Column) -> Column:
    """First run of digits, else the first number word up to ninety-nine, else null."""
    digits = F.regexp_extract(x, r"\d+", 0)
    words = F.create_map(*[F.lit(y) for w, n in NUMBER_WORDS.items() for y in (w, n)])
    tokens = F.filter(F.split(F.lower(x), r"\s+"), lambda w: F.map_contains_key(words, w))
    return F.when(digits != "", digits.try_cast("int")).otherwise(F.try_element_at(words, F.get(tokens, F.lit(0))))


def decimals(x: Column) -> Column:
    """All signed decimals."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"[-+]?\d*\.?\d+"), F.lit(0)), lambda s: s.try_cast("double"))


def parse_box(x: Column, prompt_type: str = "json") -> Column:
    """Struct (box array<double>, normalized boolean): the first four-number box of an answer.

    ``json``: anywhere in brackets; ``plain``: "x1,y1,x2,y2 label" at the start of the first line. A box within the unit
    square is scaled to thousandths and flagged; without a box, or for null, [0, 0, 0, 0] and false.
    """
    if prompt_type == "json":
        pattern, line = r"\[\s*(" + r"\s*,\s*".join([NUMBER] * 4) + r")\s*\]", x
    elif prompt_type == "plain":
        pattern, line = r"^(\d+,\d+,\d+,\d+)\s+.+", strip(F.split(strip(x), "\n")[0])
    else:
        raise ValueError(f"Unknown prompt type: {prompt_type}")
    numbers = F.transform(F.split(F.regexp_extract(line, pattern, 1), r"\s*,\s*"), lambda v: v.try_cast("double"))

    def judged(box: Column) -> Column:
        found = F.coalesce(F.forall(box, lambda v: v.isNotNull()), F.lit(False))
        unit = found & F.forall(box, lambda v: v <= 1)
        scaled = F.transform(box, lambda v: (v * 1000).cast("int").cast("double"))
        return F.struct(F.when(unit, scaled).when(found, box).otherwise(F.array(*[F.lit(0.0)] * 4)).alias("box"), unit.alias("normalized"))

    return let(numbers, judged)


def int_boxes(x: Column) -> Column:
    """Bracketed lists of whole numbers, as arrays."""
    return F.transform(F.regexp_extract_all(x, F.lit(BOX), F.lit(1)), lambda s: F.transform(F.split(s, r"\s*,\s*"), lambda v: v.try_cast("int")))


def plain_boxes(x: Column) -> Column:
    """Boxes of eight numbers if there are any, else boxes of four."""
    found = [F.regexp_extract_all(x, F.lit(",".join([r"\d+"] * n)), F.lit(0)) for n in (8, 4)]
    texts = F.when(F.size(found[0]) > 0, found[0]).otherwise(found[1])
    return F.transform(texts, lambda s: F.transform(F.split(s, ","), lambda v: v.try_cast("int")))


def strip_fence(x: Column) -> Column:
    """The inside of a ```json fence."""
    return strip(F.regexp_replace(x, r"^```json|\n```$", ""))


def json_boxes(x: Column) -> Column:
    """array<struct<bbox_2d, label>> of a fenced JSON answer; null if it can't be parsed."""
    return F.from_json(strip_fence(x), "array<struct<bbox_2d array<double>, label string>>")


def has_box(x: Column) -> Column:
    return F.rlike(x, F.lit(BOX))


def are_all_boxes(x: Column) -> Column:
    """The text is nothing but four-number boxes."""
    return F.rlike(F.rtrim(strip(x), F.lit(".")), F.lit(rf"^{FOUR}(?:\s*,\s*{FOUR})*\s*$"))


def same_boxes(a: Column, b: Column) -> Column:
    """Both have boxes, and the same ones in the same order."""
    x, y = (F.regexp_extract_all(c, F.lit(BOX), F.lit(1)) for c in (a, b))
    return let(x, lambda x: (F.size(x) > 0) & (x == y))


def remove_boxes(x: Column) -> Column:
    """Boxes and the white space after each are taken out."""
    return F.regexp_replace(x, BOX + r"\s", "")


def denormalize_boxes(x: Column, w: Column, h: Column) -> Column:
    """Rewrites each bracketed list of percentages as whole pixels; lists whose length isn't a multiple of four stay."""
    pattern = r"\[\d+(?:,\s*\d+)*\]"
    hits, rest = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern)

    def pixels(s: Column) -> Column:
        scaled = lambda v: F.transform(v, lambda c, i: (c * F.when(i % 2 == 0, w).otherwise(h) / 100).cast("bigint").cast("string"))
        whole = F.transform(F.split(F.translate(s, "[] ", ""), ","), lambda c: c.cast("bigint"))
        return let(whole, lambda v: F.when(F.size(v) % 4 == 0, F.concat(F.lit("["), F.array_join(scaled(v), ", "), F.lit("]"))).otherwise(s))

    new = F.transform(hits, pixels)  # each list is found and rewritten once
    return let(new, lambda new: F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(new, i), F.lit("")))), ""))


_FORM = "[" + ", ".join(f"{axis}_{end}" for end in ("min", "max") for axis in "xy") + "]"
_WANTED = [f"Include {what} of the form {_FORM} for each identified {thing} in your response{stop}" for what, thing, stop in (("bounding boxes", "object", ""), ("a bounding box", "building", "."))]
GROUNDING_PHRASES = ("This is a satellite image:", "<video>", "<image>", "Identify", "the location of", *_WANTED, "If there are no such buildings, do not output a bounding box", "What is ")


def grounding_category(prompt: Column) -> Column:
    """What a grounding prompt asks for."""
    x = prompt
    for phrase in GROUNDING_PHRASES:
        x = F.replace(x, F.lit(phrase), F.lit(""))
    x = F.translate(x, "0123456789", "")
    for old, new in (("all ", ""), ("  ", " "), ("?", "")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return strip(strip(strip(strip(x, ".")), "."))


def grounding_answer(text: Column, prompt: Column, as_json: bool = False) -> Column:
    """An answer of boxes alone, rewritten as one box and category a line, or as fenced JSON."""
    name = grounding_category(prompt)
    boxes = F.transform(F.regexp_extract_all(text, F.lit(r"\[\d+,\s*\d+,\s*\d+,\s*\d+\]"), F.lit(0)), lambda s: F.split(F.translate(s, "[] ", ""), ","))
    if as_json:
        label = F.to_json(F.struct(name.alias("v")))
        items = F.transform(boxes, lambda b: F.concat(F.lit('{"bbox_2d": ['), F.array_join(b, ", "), F.lit('], "label": '), F.substring(label, F.lit(6), F.length(label) - 6), F.lit("}")))
        return F.concat(F.lit("```json\n[\n\t"), F.array_join(items, ",\n\t"), F.lit("\n]\n```"))
    return F.concat(F.array_join(F.transform(boxes, lambda b: F.concat_ws(" ", F.array_join(b, ","), name)), "\n"), F.lit("\n"))


def plain_instances(x: Column) -> Column:
    """array<struct<poly array<int>, label string>> of lines "x1,...,x8 label"; lines of other forms are dropped, polygons
    of more than eight numbers cut to eight (X9, F8)."""

    def one(line: Column) -> Column:
        parts = F.split(line, " ", 2)
        poly = F.transform(F.split(parts[0], ","), lambda c: strip(c).try_cast("int"))
        return F.struct(poly.alias("poly"), F.lower(strip(F.get(parts, F.lit(1)))).alias("label"))

    ok = lambda e: e["label"].isNotNull() & F.forall(e["poly"], lambda v: v.isNotNull()) & (F.size(e["poly"]) >= 8)
    lines = F.filter(F.split(strip(x), r"\r?\n"), lambda s: strip(s) != "")
    return F.transform(F.filter(F.transform(lines, one), ok), lambda e: F.struct(F.slice(e["poly"], 1, 8).alias("poly"), e["label"].alias("label")))


def repair_json(x: Column) -> Column:
    """A JSON list with the usual slips mended: wrong brackets, repeated and missing commas, repeated labels; lines that still
    don't parse are dropped (X10). A list that parses as it is stays."""

    def mended(body: Column) -> Column:
        y = F.translate(body, "()", "[]")
        for pattern, by in ((r"(, *)+", ", "), (r"(\d)\s+(\d)", "$1, $2"), (r'("label":\s*)+', '"label": ')):
            y = F.regexp_replace(y, pattern, by)
        lines = F.filter(F.split(y, "\n"), lambda s: let(strip(strip(s), ","), lambda t: (t != "") & F.try_parse_json(t).isNotNull()))
        return F.concat(F.lit("[\n"), F.rtrim(F.array_join(lines, "\n"), F.lit(", ")), F.lit("\n]"))

    body = F.replace(F.replace(x, F.lit("```json\n"), F.lit("")), F.lit("\n```"), F.lit(""))
    return let(body, lambda b: F.when(F.try_parse_json(b).isNotNull(), b).otherwise(mended(b)))


def json_instances(x: Column) -> Column:
    """array<struct<poly, label>> of a repaired JSON answer; items without an all-integer polygon of eight or more are
    dropped (X10, F8)."""
    items = F.from_json(repair_json(x), "array<struct<`quadrant bbox`: array<string>, label: string>>")
    cast = F.transform(items, lambda e: F.struct(F.transform(e["quadrant bbox"], lambda v: F.when(F.rlike(v, F.lit(r"^-?\d+$")), v.try_cast("int"))).alias("poly"), F.lower(e["label"]).alias("label")))
    ok = lambda e: e["label"].isNotNull() & (F.size(e["poly"]) >= 8) & F.forall(e["poly"], lambda v: v.isNotNull())
    return F.transform(F.filter(cast, lambda e: F.coalesce(ok(e), F.lit(False))), lambda e: F.struct(F.slice(e["poly"], 1, 8).alias("poly"), e["label"].alias("label")))


def tool_call_box(x: Column) -> Column:
    """bbox_2d of a <tool_call>; null (the whole image) when it can't be parsed (X11)."""
    body = F.regexp_extract(x, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1)
    return F.from_json(body, "struct<name string, arguments struct<bbox_2d array<double>>>")["arguments"]["bbox_2d"]


def split_thinking(x: Column) -> Column:
    """Struct (think, output): the <think> prefix and what follows."""
    think = F.regexp_extract(x, r"(?s)^\s*<think>(.*?)</think>", 1)
    has = F.rlike(x, F.lit(r"(?s)^\s*<think>.*?</think>"))
    return F.struct(F.when(has, strip(think)).alias("think"), F.when(has, strip(F.regexp_replace(x, r"(?s)^\s*<think>.*?</think>", ""))).otherwise(x).alias("output"))


def detect_task(question: Column, answer: Column) -> Column:
    """caption / referring / vqa."""
    q = F.lower(question)
    caption = F.contains(q, F.lit("describe")) | F.contains(q, F.lit("caption"))
    return F.when(caption, "caption").when(F.rlike(strip(answer), F.lit(r"^\{(<\d+>)+\}$")), "referring").otherwise("vqa")


#: Contractions whose apostrophe answers tend to lose.
_NT = "aren can couldn didn doesn don hadn hasn haven isn mightn mustn needn shouldn wasn weren won wouldn".split()
CONTRACTIONS = {f"{w}t": f"{w}'t" for w in _NT} | {
    "aint": "ain't", "ive": "i've", "im": "i'm", "theyre": "they're", "theyve": "they've", "theyd": "they'd", "youre": "you're", "youve": "you've", "youll": "you'll", "youd": "you'd", "shes": "she's", "hes": "he's",
    "whats": "what's", "whos": "who's", "wheres": "where's", "thats": "that's", "theres": "there's", "weve": "we've", "wouldve": "would've", "couldve": "could've", "shouldve": "should've", "mightve": "might've", "yall": "y'all", "lets": "let's",
}
ANSWER_NUMBERS = {"none": "0"} | {w: str(i) for i, w in enumerate(_ONES[:11])}
_MARKS = list("!?,`@<>-_\\+=)(}{\"][/;")


def normalize_answer(x: Column) -> Column:
    """Answer normaliser of the open VQA metrics (X3): commas, question marks and articles go, number words become
    digits, contractions get their apostrophe; a mark next to a space vanishes, any other becomes a space."""
    t = strip(F.replace(F.replace(F.replace(F.lower(x), F.lit(","), F.lit("")), F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" 's")))
    t = strip(F.translate(t, "\n\t", "  "))

    def without_marks(t: Column, comma: Column) -> Column:
        out = t
        for m in _MARKS:
            gone = comma | F.contains(t, F.lit(m + " ")) | F.contains(t, F.lit(" " + m))
            out = F.replace(out, F.lit(m), F.when(gone, F.lit("")).otherwise(F.lit(" ")))
        return out

    marks = "[" + re.escape("".join(_MARKS)) + "]"
    out = let(t, lambda t: F.when(~F.rlike(t, F.lit(marks)), t).otherwise(let(F.rlike(t, F.lit(r"(?<=\d),+(?=\d)")), lambda comma: without_marks(t, comma))))
    out = F.regexp_replace(out, r"\.(?!\d)", "")
    words = F.create_map(*[F.lit(y) for pair in (ANSWER_NUMBERS.items()) for y in pair])
    short = F.create_map(*[F.lit(y) for pair in (CONTRACTIONS.items()) for y in pair])
    tokens = F.transform(F.filter(F.split(F.lower(out), r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(words, w), w))
    tokens = F.filter(tokens, lambda w: ~w.isin("a", "an", "the"))
    return F.array_join(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def anls(pred: Column, answer: Column) -> Column:
    """1 - edit distance / longer length, and 0 below one half; two empty strings are equal: 1."""
    p, a = strip(F.lower(pred)), strip(F.lower(answer))
    longest = F.greatest(F.length(p), F.length(a))
    s = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(p, a) / longest)
    return F.when(s >= 0.5, s).otherwise(0.0)


def soft_vqa_score(pred: Column, answers: Column) -> Column:
    """Mean over the n human answers of min(1, others that agree with pred / 3), in closed form."""
    n, k = F.size(answers), F.size(F.filter(answers, lambda a: a == pred))
    return F.when(k > 0, (k * F.least(F.lit(1.0), (k - 1) / 3) + (n - k) * F.least(F.lit(1.0), k / 3)) / n).otherwise(0.0)


def st_vqa_ok(pred: Column, answers: Column) -> Column:
    """The normalised answer is one of the normalised true ones."""
    return let(normalize_answer(pred), lambda p: F.exists(F.array_distinct(answers), lambda a: normalize_answer(a) == p))


def sampling_rate(x: Column) -> Column:
    """``name%50`` -> 0.5, ``name*3`` -> 3, ``name`` -> 1."""
    p, m = F.regexp_extract(x, r"%\s*([\d.]+)$", 1), F.regexp_extract(x, r"\*\s*([\d.]+)$", 1)
    return F.when(p != "", p.try_cast("double") / 100).when(m != "", m.try_cast("double")).otherwise(1.0)


def benchmark_suffix(x: Column) -> Column:
    """Struct (name, shots, is_unique) of ``name[_unique]_k``."""
    pattern = r"^(.*?)(_unique)?_(\d+)$"
    k = F.regexp_extract(x, pattern, 3)
    return F.struct(F.when(k != "", F.regexp_extract(x, pattern, 1)).otherwise(x).alias("name"), F.coalesce(k.try_cast("int"), F.lit(0)).alias("shots"), (F.regexp_extract(x, pattern, 2) != "").alias("is_unique"))


# --- likeness of labels ------------------------------------------------------------------------------------------------


def indel_ratio(a: str, b: str) -> float:
    """Share of the letters of both that a longest common subsequence covers, in percent; 100 for two empty texts."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    bits: dict[str, int] = {}
    for i, c in enumerate(a):
        bits[c] = bits.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    left = every
    for c in b:
        hit = left & bits.get(c, 0)
        left = ((left + hit) | (left - hit)) & every
    return 200.0 * (len(a) - left.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer one, which may hang over an end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    pairs = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max(indel_ratio(x, y[max(0, k) : k + len(x)]) for x, y in pairs for k in range(1 - len(x), len(y)))


def _token_ratios(a: str, b: str, ratio) -> float:
    """The better of the ratios with words sorted, and as sets: what both have against each with its own words."""
    x, y = sorted(a.split()), sorted(b.split())
    both, own = sorted({*x} & {*y}), [sorted({*p} - {*q}) for p, q in ((x, y), (y, x))]
    best = ratio(" ".join(x), " ".join(y))
    if not x or not y:
        return best
    if both and not all(own):
        return 100.0
    if ratio is partial_ratio:
        return 100.0 if both else max(best, ratio(*(" ".join(o) for o in own)))
    joined = [" ".join([*both, *o]) for o in own]
    pairs = [joined] + ([(" ".join(both), j) for j in joined] if both else [])
    return max([best, *(ratio(*p) for p in pairs)])


def weighted_ratio(a: str, b: str) -> float:
    """Likeness of two labels from 0 to 100 (J12): the plain ratio, the ratios by words at 0.95, and for lengths that differ by half or more
    those of a stretch, at 0.9, or 0.6 beyond eight times the length."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    plain = indel_ratio(a, b)
    if apart < 1.5:
        return max(plain, 0.95 * _token_ratios(a, b, indel_ratio))
    scale = 0.9 if apart < 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * _token_ratios(a, b, partial_ratio))


def ptb_tokens(x: Column) -> Column:
    """Lower-cased words in the manner of the Penn treebank, without punctuation (A20): contractions are cut before their apostrophe."""
    y = F.lower(x)
    for pattern, by in ((r"([\w.])(n't)\b", r"$1 $2"), (r"('(?:s|m|d|re|ve|ll))\b", r" $1"), (r"\.\.\.|--+", " "), (r"([^\w\s'.,:/-])", " "), (r"(?<![0-9])[.,:/]|[.,:/](?![0-9])", " "), (r"(?<!\w)-|-(?!\w)", " "), (r"(?:^|\s)'(?!(?:s|m|d|re|ve|ll)\b)|'(?:\s|$)", " ")):
        y = F.regexp_replace(y, pattern, by)
    return F.filter(F.split(y, r"\s+"), lambda w: w != "")

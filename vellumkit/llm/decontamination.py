"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to lower-cased words joined by single spaces; in scripts that don't set words apart
each letter is a word. A passage is a run of ``ngram`` words that a text shares with an item (of an item of fewer words: all of them).
The patterns are an item's blocks of half as many words, cut at every half: any such run has one whole block in it, so nothing
is missed, and the automaton is about as large as the benchmark. Each text is normalised alike and scanned once; a block that is
met is extended by comparing words to both sides, and matches are mapped back to offsets in the original text.

The benchmark doesn't grow with the corpus: it goes out by broadcast, and each worker builds its automaton once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..runtime import prepare

WORD = re.compile(r"\w+")
#: Letters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED, _EITHER = re.compile(f"[{UNSPACED}]"), re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")
#: An item of fewer words is evidence only if it has ``MIN_LETTERS`` letters at least.
NGRAM, MIN_WORDS, MIN_LETTERS = 10, 5, 24


def _words(lower: str) -> re.Pattern:
    return WORD if lower.isascii() or not _UNSPACED.search(lower) else _EITHER


def normalise(text: str) -> str:
    """' a b c ': words between single spaces."""
    lower = text.lower()
    return f" {' '.join(_words(lower).findall(lower))} "


class Items:
    """The automaton over the items (item_id, text); each pattern's value is its words and the (item's place, first word) that have it."""

    def __init__(self, items: list[tuple[int, str]], ngram: int = NGRAM, min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS):
        self.ids, self.words = [], []
        for item, text in items:
            words = normalise(text).split()
            if words and (len(words) >= min_words or sum(map(len, words)) >= min_letters):
                self.ids.append(item), self.words.append(words)
        self.ngram, half = ngram, (ngram + 1) // 2
        found: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            block = min(half, len(words))
            for at in range(0, len(words) - block + 1, block):
                found.setdefault(f" {' '.join(words[at : at + block])} ", []).append((k, at))
        self.auto = ahocorasick.Automaton()
        for pattern, where in found.items():
            self.auto.add_word(pattern, (pattern.count(" ") - 1, where))
        if found:
            self.auto.make_automaton()

    def runs(self, norm: str) -> dict[int, list[tuple[int, int]]]:
        """Of each item's place that has any: the runs [first, last) of words of the text that are long enough, each as long as can be."""
        out: dict[int, list[tuple[int, int]]] = {}
        words, read, at = None, 0, 0
        done: dict[tuple[int, int], int] = {}  # of an item and a shift: the word up to which it was compared
        for end, (n, where) in self.auto.iter(norm) if len(self.auto) else ():
            read += norm.count(" ", at, end)  # spaces before the one that ends the match: words read so far
            at = end
            if words is None:
                words = norm.split()
            for k, q in where:
                own, a, b = self.words[k], read - n, read
                shift = a - q
                if done.get((k, shift), -1) >= b:
                    continue
                while a > max(0, shift) and words[a - 1] == own[a - 1 - shift]:
                    a -= 1
                most = min(len(words), len(own) + shift)
                while b < most and words[b] == own[b - shift]:
                    b += 1
                done[k, shift] = b
                if b - a >= min(self.ngram, len(own)):
                    out.setdefault(k, []).append((a, b))
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, end, words, coverage) of each passage: the longest stretch of runs of one item that overlap or
        touch, in offsets of the original text; coverage: the share of the item's words in it, 1 at most."""
        runs = self.runs(normalise(text))
        if not runs:
            return []
        # Words are those of the lower-cased text, in which a letter may have become two; its offsets are mapped back by letter.
        lower = text.lower()
        spans = [m.span() for m in _words(lower).finditer(lower)]
        back = None
        if len(lower) != len(text):
            back = [i for i, c in enumerate(text) for _ in c.lower()]
            back.append(len(text))
        out = []
        for k, parts in runs.items():
            parts.sort()
            merged = [list(parts[0])]
            for a, b in parts[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                start, end = spans[a][0], spans[b - 1][1]
                if back:
                    start, end = back[start], back[end - 1] + 1
                out.append((self.ids[k], start, end, b - a, round(min(1.0, (b - a) / len(self.words[k])), 6)))
        return sorted(out)


_ready: dict[str, Items] = {}


def _built(token: str, sent: Broadcast) -> Items:
    """The automaton of a run, which a worker keeps from task to task."""
    if token not in _ready:
        _ready.clear()
        _ready[token] = Items(*sent.value)
    return _ready[token]


def _sent(benchmark: DataFrame, ngram: int, min_words: int, min_letters: int) -> tuple[str, Broadcast]:
    spark = prepare(benchmark.sparkSession)
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    return uuid.uuid4().hex, spark.sparkContext.broadcast(([tuple(r) for r in rows.toLocalIterator()], ngram, min_words, min_letters))


def contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """A row for each passage of an item in a document: doc_id, item_id, start, end (offsets in Unicode characters of the
    original text), n_words, coverage.

    Clean documents, null and empty texts give no row; a row with a null doc_id is scanned and keeps its null; rows that repeat give
    their passages again; whole texts of any length are scanned. Other columns are not read. Items of a null id or text are
    left out, as are those of fewer than ``min_words`` words that also have fewer than ``min_letters`` letters: an
    answer like "yes" is no evidence. Items that repeat word for word under another id are each reported, as is each text of an
    item_id that has several. An empty benchmark gives no rows.
    """
    token, sent = _sent(benchmark, ngram, min_words, min_letters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(token, sent)
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1)) if t.is_valid for m in items.matches(t.as_py())]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start", "end", "n_words", "coverage"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, "doc_id bigint, item_id bigint, start bigint, end bigint, n_words int, coverage double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of an item, with all its columns, whatever their names; rows
    with a null or empty text stay, and rows that repeat are judged alike. With an empty benchmark all rows stay."""
    token, sent = _sent(benchmark, ngram, min_words, min_letters)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = _built(token, sent)
        for texts in batches:
            yield pa.array([not t.is_valid or not items.runs(normalise(t.as_py())) for t in texts], pa.bool_())

    return docs.where(clean(F.col("text").cast("string")))

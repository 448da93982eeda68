"""Language-model scoring by compression cross-entropy.

The size of a text under zstandard with a dictionary stands for its cross-entropy under a model of the dictionary's
corpus. There are two dictionaries: one of the in-domain documents (label quality 1) and one of all documents. The
score is the normalised difference of the sizes, (general - in_domain) / general: above 0, a text looks more like the
in-domain documents than like the corpus.

A dictionary is raw content: every word that was counted, by count x length, the best at the end, where matches are
cheapest. Words are counted over all documents: each task counts its own, and the counts, which grow with the corpus,
are shuffled by word. So the dictionaries grow with the vocabulary, and zstandard's hash tables with them; only
``MOST_BYTES``, what zstandard can load, is a limit. They go over the driver to the workers. Texts are scanned once for each dictionary,
so that a worker holds one at a time, digested, at about four times its size; the sizes of a text meet by its id and hash.

The match finder is the greedy one: the faster ones keep but the last 16 MB of a dictionary. A text is compressed in chunks
of ``CHUNK`` bytes, up to which zstandard searches a digested dictionary where it is; for longer inputs it would copy the
tables, hundreds of MB, each time. Its size is the sum over all its chunks.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..runtime import checkpoint, join_checked, prepare

MOST_BYTES, LEVEL, FLUSH, CHUNK = (1 << 31) - (1 << 20), 5, 200_000, 1 << 15
#: Bits by which the hash table has fewer entries than the dictionary has bytes; bits of the entries tried; bytes of the least match.
HASH, SEARCH, MATCH = 1, 5, 6

#: In a worker: the compressor of the dictionary it is at.
_ready: dict[str, zstandard.ZstdCompressor] = {}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in (in_domain, text): a row for each word, at times several. The memory is bounded by flushing."""
    _ready.clear()  # a worker may hold the dictionaries of an earlier run
    counts: tuple[Counter, Counter] = (Counter(), Counter())  # of the other documents, of those in the domain

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        own = [counts[1][w] for w in names]
        every = [counts[0][w] + n for w, n in zip(names, own)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(own, pa.int64()), pa.array(every, pa.int64())], names=["word", "n_in", "n_all"])

    for b in batches:
        for inside, t in zip(b.column(0).to_pylist(), b.column(1)):
            if t.is_valid:
                counts[inside].update(t.as_py().split())
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield out()
    yield out()


def word_counts(docs: DataFrame, in_domain: DataFrame) -> DataFrame:
    """(word, n_in, n_all) over all documents; in_domain: doc_ids. Words are what white space separates."""
    ids = checkpoint(in_domain.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("__id")).distinct())
    marked = join_checked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), ids.withColumn("__in", F.lit(True)), F.col("doc_id") == F.col("__id"), "left", 80)
    parts = marked.select(F.coalesce("__in", F.lit(False)).alias("inside"), "text").mapInArrow(_counted, "word string, n_in bigint, n_all bigint")
    return parts.groupBy("word").agg(F.sum("n_in").alias("n_in"), F.sum("n_all").alias("n_all"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(b.column(0).to_pylist()).encode("utf-8", "surrogatepass")], pa.binary())], names=["part"])


def dictionary(counts: DataFrame, column: str, size: int = MOST_BYTES) -> bytes:
    """All words, by count x bytes of UTF-8 (ties: the lesser word last), between spaces. If they are more than ``size`` bytes,
    spaces included, those of the largest gains are taken in turn, and one that no longer fits is passed over.

    Then a histogram of the gains, of some hundred rows, tells the least gain at which the size is reached; only words from there on are sorted.
    """
    cost = F.octet_length("word") + 1
    words = counts.where(F.col(column) > 0).select("word", (F.col(column) * cost).alias("gain"), cost.alias("cost"), F.floor(8 * F.log2(F.col(column) * cost)).alias("level"))
    if (words.agg(F.sum("cost")).first()[0] or 0) < size:
        parts = [r["part"] for r in words.orderBy("gain", F.desc("word")).select("word").mapInArrow(_joined, "part binary").toLocalIterator() if r["part"]]
        return b" ".join([b"", *parts, b""]) if parts else b""
    words = words.where(F.col("cost") < size)
    least, filled = None, 0
    for r in sorted(words.groupBy("level").agg(F.sum("cost").alias("cost")).collect(), key=lambda r: -r["level"]):
        least, filled = r["level"], filled + r["cost"]
        if filled >= size:
            break
    if least is None:
        return b""
    best, left = [], size - 1
    for r in words.where(F.col("level") >= least).orderBy(F.desc("gain"), "word").select("word").toLocalIterator():
        w = r["word"].encode("utf-8", "surrogatepass")
        if left > len(w):
            left -= len(w) + 1
            best.append(w)
    return b" ".join([b"", *best[::-1], b""])


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if len(content) < 8:  # the least that zstandard takes as a dictionary
        return zstandard.ZstdCompressor(level=LEVEL)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bits = len(content).bit_length()
    fit = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, strategy=zstandard.STRATEGY_GREEDY, window_log=min(31, max(17, bits + 1)), hash_log=max(12, bits - HASH), chain_log=max(12, bits - HASH), search_log=SEARCH, min_match=MATCH, target_length=0
    )
    held.precompute_compress(compression_params=fit)
    return zstandard.ZstdCompressor(compression_params=fit, dict_data=held)


def size_of(raw: bytes, by: zstandard.ZstdCompressor) -> int:
    """Bytes of all chunks, compressed; an empty text is one empty chunk."""
    return sum(len(by.compress(raw[a : a + CHUNK])) for a in range(0, max(1, len(raw)), CHUNK))




def _digested(token: str, sent: Broadcast) -> zstandard.ZstdCompressor:
    """The compressor of a dictionary, which a worker keeps from task to task, as digesting takes as long as the dictionary is. It holds
    one at a time."""
    if token not in _ready:
        _ready.clear()
        _ready[token] = compressor(sent.value)
        vars(sent).pop("_value", None)  # zstandard has its own copy
    return _ready[token]


def _sizes(docs: DataFrame, content: bytes, name: str) -> DataFrame:
    """(doc_id, h0, h1, name): the size of each row's text by one dictionary, with the 128-bit hash of the text (nulls for a null text)."""
    sent, token = docs.sparkSession.sparkContext.broadcast(content), uuid.uuid4().hex

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _digested(token, sent)
        for b in batches:
            sizes, halves = [], ([], [])
            for t in b.column(1):
                raw = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else None
                sizes.append(None if raw is None else size_of(raw, by))
                for half, at in zip(halves, (0, 8)):
                    half.append(None if raw is None else int.from_bytes(xxhash.xxh3_128_digest(raw)[at : at + 8], "big", signed=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (*halves, sizes))], names=["doc_id", "h0", "h1", name])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sized, f"doc_id bigint, h0 bigint, h1 bigint, {name} bigint")


def lm_scores(docs: DataFrame, in_domain: DataFrame) -> DataFrame:
    """(doc_id, in_size, general_size, score) for each row of ``docs``, repeated ones too.

    A null text has null sizes and score; an empty text has the sizes of an empty frame. Without in-domain documents, or without
    words, the dictionary is empty and the text is compressed without one. Whole texts are counted and compressed. Other columns are not read.
    """
    prepare(docs.sparkSession)
    counts = checkpoint(word_counts(docs, in_domain))
    inside, general = (_sizes(docs, dictionary(counts, c), name) for c, name in (("n_in", "in_size"), ("n_all", "general_size")))
    both = inside.withColumn("n", F.lit(1)).unionByName(general, allowMissingColumns=True)  # a task has one dictionary, so a worker holds one
    out = both.groupBy("doc_id", "h0", "h1").agg(F.max("in_size").alias("in_size"), F.max("general_size").alias("general_size"), F.sum("n").alias("n"))
    score = F.round((F.col("general_size") - F.col("in_size")) / F.col("general_size"), 6)
    return out.select("doc_id", "in_size", "general_size", score.alias("score"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("n")).drop("n")

"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: its lower-cased words and their prefixes of 4 to 6 letters (which catch
inflected and compound forms). The score is ``b + sum(w_i) + sum over pairs of terms <v_i, v_j>``: the pair part learns
what two terms say together, such as an insult beside the name of a group, which a linear model misses.

Training takes at most ``train_rows`` labelled documents (those with the least hash of the id, so the same at each
run). Two kinds of terms are used: those whose own log odds between the classes are ``MIN_Z`` standard errors from zero, and
those that tell something only together: of terms in ``PAIR_SHARE`` of the rows at least, all pairs are counted, and a pair
is evidence if its rate of toxic documents is ``PAIR_Z`` standard errors from the rates of both its terms, to the same side.
All others weigh nothing. Scoring covers all documents, whole texts of any length, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import prepare

WORD = re.compile(r"[^\W\d_]+")
#: Parameters: buckets of the hash, factors, most labelled rows to fit on, and the probability from which a document is toxic.
BUCKETS, FACTORS, TRAIN_ROWS, THRESHOLD = 1 << 20, 8, 12_000, 0.5
EPOCHS, BATCH, RATE, DECAY, MIN_DOCS, MIN_Z = 30, 64, 0.2, 1e-4, 3, 3.0
PAIR_SHARE, PAIR_DOCS, PAIR_Z, TILE = 0.02, 20, 8.0, 512
#: Tokens (what white space separates) whose terms a worker keeps; beyond that it starts anew.
KEPT_TOKENS = 1 << 20
#: Texts that are scored at once.
SCORED = 256


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}{k}" for k in (6, 5, 4) if len(word) >= k)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _hashed_terms(names: list[str]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(BUCKETS)).astype(np.int32)


def buckets_of(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's terms."""
    return np.unique(_hashed_terms(list({t for w in words_of(text) for t in terms_of(w)})))


class Tokens(dict):
    """Numbers the tokens that are looked up, in the order in which they are met; ``new`` are those that were met since it was emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.new.append(token)
        return n


@dataclass
class Machine:
    """bias; the buckets in use, sorted; their linear weights and their factors [used, FACTORS]."""

    bias: float
    used: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.used] = np.arange(len(self.used), dtype=np.int32)
        self._forget()

    def _forget(self) -> None:
        self.tokens, self.ends, self.known = Tokens(), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        """Cut the new tokens into words and hash their terms; ``known[ends[k]:ends[k + 1]]`` are the places of token k's terms in use."""
        new, self.tokens.new = self.tokens.new, []
        terms = [[t for w in WORD.findall(x) for t in terms_of(w)] for x in new]
        at = self.place[_hashed_terms([t for own in terms for t in own])]
        owner = np.repeat(np.arange(len(new)), [len(own) for own in terms])[at >= 0]
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))))
        self.known = np.concatenate((self.known, at[at >= 0]))

    def places_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the distinct terms in use, sorted. A token is hashed when it is first met."""
        if len(self.tokens) > KEPT_TOKENS:
            self._forget()
        ids, n = [], []
        for t in texts:
            own = set(t.lower().split()) if t else ()
            ids.extend(map(self.tokens.__getitem__, own))
            n.append(len(own))
        if self.tokens.new:
            self._learn()
        ids = np.array(ids, np.int64)
        first = self.ends[ids]
        many = self.ends[ids + 1] - first
        at = self.known[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        there = np.zeros((len(texts), len(self.used)), bool)
        there[np.repeat(np.repeat(np.arange(len(texts)), n), many), at] = True
        return np.nonzero(there)

    def scores(self, texts: list[str | None]) -> list[float | None]:
        """Probabilities that texts are toxic; None for None."""
        out: list[float | None] = []
        for a in range(0, len(texts), SCORED):
            some = texts[a : a + SCORED]
            doc, at = self.places_of(some)
            z, v = self.bias + np.bincount(doc, self.linear[at], len(some)), self.factors[at]
            for f in range(v.shape[1]):
                z += 0.5 * (np.bincount(doc, v[:, f], len(some)) ** 2 - np.bincount(doc, v[:, f] ** 2, len(some)))
            out += [None if t is None else float(x) for t, x in zip(some, 1 / (1 + np.exp(-np.clip(z, -40, 40))))]
        return out

    def score(self, text: str | None) -> float | None:
        return self.scores([text])[0]


def pair_terms(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets of the terms that are in a pair with evidence of its own. Terms of the same rows count once, by the first of them."""
    n = len(rows)
    count = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    often = np.flatnonzero(count >= max(PAIR_DOCS, PAIR_SHARE * n))
    if len(often) < 2:
        return np.empty(0, np.int64)
    place = np.full(BUCKETS, -1, np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    there = np.zeros((len(often), n), np.uint8)
    for i, r in enumerate(rows):
        p = place[r]
        there[p[p >= 0], i] = 1
    bits = np.packbits(there, axis=1)
    del there
    first = np.sort(np.unique([xxhash.xxh3_64_intdigest(b.tobytes()) for b in bits], return_index=True)[1])
    often, bits = often[first], bits[first]
    toxic = np.flatnonzero(y > 0)
    docs = count[often].astype(np.float32)
    tile = lambda a: np.unpackbits(bits[a : a + TILE], axis=1, count=n).astype(np.float32)
    bad = np.concatenate([tile(a)[:, toxic].sum(axis=1) for a in range(0, len(often), TILE)])
    rate = (bad + 1) / (docs + 2)
    found = np.zeros(len(often), bool)
    for a in range(0, len(often), TILE):
        x = tile(a)
        for b in range(a, len(often), TILE):
            z = x if a == b else tile(b)
            both, hit = x @ z.T, x[:, toxic] @ z[:, toxic].T
            by = [(hit - both * r) / np.sqrt(both * r * (1 - r) + 1) for r in (rate[a : a + TILE, None], rate[None, b : b + TILE])]
            pair = (both >= PAIR_DOCS) & (by[0] * by[1] > 0) & (np.abs(by[0]) >= PAIR_Z) & (np.abs(by[1]) >= PAIR_Z)
            found[a : a + TILE] |= pair.any(axis=1)
            found[b : b + TILE] |= pair.any(axis=0)
    return often[found]


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, seed: int = 0) -> Machine:
    """Adagrad on the logistic loss; ``rows[i]`` are the distinct buckets of document i.

    Without rows of both classes the machine finds nothing toxic.
    """
    rng = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        return Machine(-1e-3, np.empty(0, np.int32), np.empty(0), np.empty((0, factors)))
    pos, neg = (np.bincount(np.concatenate([r for r, c in zip(rows, y) if c == k]), minlength=BUCKETS) for k in (1, 0))
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / (n_pos - pos + 0.5) + 1 / (n_neg - neg + 0.5))
    own = np.flatnonzero((pos + neg >= MIN_DOCS) & (np.abs(odds) >= MIN_Z * error))
    used = np.union1d(own, pair_terms(rows, y)).astype(np.int32)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    w, v, b = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), factors)), float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
    gw, gv, gb = np.full(len(used), 1e-4), np.full((len(used), factors), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a : a + BATCH]
            n = np.array([len(rows[i]) for i in pick])
            t = np.concatenate([rows[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), n)
            total = np.stack([np.bincount(doc, v[t, f], len(pick)) for f in range(factors)], axis=1)
            z = b + np.bincount(doc, w[t], len(pick)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(doc, (v[t] ** 2).sum(axis=1), len(pick)))
            err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]
            u, inv = np.unique(t, return_inverse=True)
            each = err[doc, None] * (total[doc] - v[t])
            dw = np.bincount(inv, err[doc], len(u)) / len(pick) + DECAY * w[u]
            dv = np.stack([np.bincount(inv, each[:, f], len(u)) for f in range(factors)], axis=1) / len(pick) + DECAY * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= 0.3 * RATE * dv / np.sqrt(gv[u])
            gb += err.mean() ** 2
            b -= float(RATE * err.mean() / np.sqrt(gb))
    return Machine(b, used, w, v)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = pa.array([buckets_of(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``train_rows`` labelled documents. Null labels, ids or texts are left out; a label other than 0 is toxic.
    Rows that repeat a doc_id are one document, with its least text; labels that do are toxic if one of them is."""
    prepare(docs.sparkSession)
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # at most train_rows rows
    rows = texts.select(F.col("__id").alias("id"), "toxic", "text").mapInArrow(_hashed, "id bigint, toxic int, terms array<int>")
    got = rows.toArrow().combine_chunks()
    ids, y, terms = got["id"].to_numpy(), got["toxic"].to_numpy().astype(np.float64), got["terms"].to_numpy()
    order = np.argsort(ids)  # rows arrive in no fixed order
    return fit([terms[i] for i in order], y[order])


def scorer(docs: DataFrame, machine: Machine) -> F.Column:
    """Column of the probability, for the column ``text``. The machine (the terms that tell the classes apart in the bounded sample) goes out by broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.used, machine.linear, machine.factors))
    held: list[Machine] = []

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(Machine(*sent.value))
        for texts in batches:
            yield pd.Series(held[0].scores([None if t is None else t for t in texts]), dtype="float64")

    return probability(F.col("text").cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) for each row of ``docs``, repeated rows included. A null text has a null score and isn't
    toxic; an empty text has the score of no words, as has a table's every text where ``labels`` lacks a class. Other columns are not read."""
    score = scorer(docs, train(docs, labels))
    out = docs.select("doc_id", score.alias("score"))
    return out.select("doc_id", F.round("score", 6).alias("score"), F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that are toxic, with all its columns, whatever their names; rows with a null text stay, and
    rows that repeat are judged alike. An empty table stays empty."""
    score = scorer(docs, train(docs, labels))
    return docs.where(F.coalesce(score < threshold, F.lit(True)))

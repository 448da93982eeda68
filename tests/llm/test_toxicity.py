import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumkit.llm import toxicity as X

from .common import CLASHING, docs_of, edge_docs, edge_rows, empty_docs

LABELS = "doc_id bigint, quality int, toxic int"


def sample(n, seed, rule):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}ly" for k in range(300)]
    out = []
    for k in range(n):
        ws = rng.choices(vocab, k=40)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        ws += ["idiotic"] * insult + ["martians"] * group
        rng.shuffle(ws)
        out.append((k, " ".join(ws), int(rule(insult, group))))
    return out


def fit(rows):
    return X.fit([X.buckets_of(t) for _, t, _ in rows], np.array([y for *_, y in rows], float))


def accuracy(m, rows):
    return np.mean([(m.score(t) >= 0.5) == y for _, t, y in rows])


def test_learns_the_pair():
    """Toxic only if the insult meets the group: the factors do what the weights alone can't."""
    train, held = sample(1500, 1, lambda i, g: i and g), sample(500, 2, lambda i, g: i and g)
    m = fit(train)
    assert accuracy(m, held) > 0.97
    used = m.factors[m.place[X.buckets_of("idiotic martians")]]
    assert abs(used.sum(axis=0) @ used.sum(axis=0) - (used * used).sum()) > 0.5  # the pair term is in use


def test_learns_a_pair_without_evidence_of_its_terms():
    """Toxic if exactly one of the two is there: neither term alone tells anything."""
    train, held = sample(3000, 1, lambda i, g: i != g), sample(1000, 2, lambda i, g: i != g)
    m = fit(train)
    assert accuracy(m, held) > 0.9
    assert (m.place[X.buckets_of("idiotic martians")] >= 0).sum() >= 2  # terms of the same rows count once


def test_pairs_against_brute_force():
    rng = np.random.default_rng(3)
    there = rng.random((1200, 40)) < 0.3
    y = ((there[:, 3] ^ there[:, 7]) | (rng.random(1200) < 0.05)).astype(float)
    want = set()
    for a in range(40):
        for b in range(a):
            both = there[:, a] & there[:, b]
            n, k = both.sum(), y[both].sum()
            zs = [(k - n * r) / np.sqrt(n * r * (1 - r) + 1) for c in (a, b) for r in [(y[there[:, c]].sum() + 1) / (there[:, c].sum() + 2)]]
            if n >= X.PAIR_DOCS and min(map(abs, zs)) >= X.PAIR_Z and zs[0] * zs[1] > 0:
                want |= {a, b}
    assert set(X.pair_terms([np.flatnonzero(r).astype(np.int32) for r in there], y)) == want >= {3, 7}


def test_tokens_are_hashed_anew_when_too_many(monkeypatch):
    m = fit(sample(400, 3, lambda i, g: i and g))
    texts = [t for _, t, _ in sample(60, 4, lambda i, g: i)]
    want = m.scores(texts)
    monkeypatch.setattr(X, "KEPT_TOKENS", 50)
    monkeypatch.setattr(X, "SCORED", 7)
    m._forget()
    assert m.scores(texts) == want == [m.score(t) for t in texts] and len(m.tokens) < 300


def test_a_repeated_labelled_document_is_trained_on_once(spark):
    rows = [(1, f"text {k % 7}", "s") for k in range(500)] + [(2, "other words", "s")]
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)
    seen = []
    fit_of, X.fit = X.fit, lambda r, y: seen.append((r, y)) or fit_of(r, y)
    try:
        X.train(docs_of(spark, rows), labels)
    finally:
        X.fit = fit_of
    ((r, y),) = seen
    assert len(r) == 2 and y.tolist() == [1.0, 0.0] and (r[0] == X.buckets_of("text 0")).all()


def test_held_out_accuracy_on_the_tables(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    l = l.withColumn("held", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(4)) == 0)
    out = X.scorer(d, X.train(d, l.where("not held")))
    got = d.join(l.where("held").select("doc_id", F.col("toxic").alias("y")), "doc_id").select("y", (out >= 0.5).alias("p")).toPandas()
    assert (got["p"] == (got["y"] == 1)).mean() > 0.97
    assert got.loc[got["y"] == 0, "p"].mean() < 0.01


def test_score_is_the_formula():
    m = fit(sample(400, 3, lambda i, g: i and g))
    t = "idiotic martians waaly"
    at = m.place[X.buckets_of(t)]
    at = at[at >= 0]
    z = m.bias + m.linear[at].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(at) for b in at[:i])
    assert m.score(t) == pytest.approx(1 / (1 + np.exp(-z)))
    assert m.score(None) is None and m.score("") == pytest.approx(1 / (1 + np.exp(-m.bias)))


def test_tokens_are_cut_into_the_same_words():
    m = X.Machine(0.0, np.arange(X.BUCKETS, dtype=np.int32), np.zeros(X.BUCKETS), np.zeros((X.BUCKETS, 1)))
    for t in ("a-b c_d, e2f  x\u00b2y \u0130\u00df\u3000end", "", " ", "idiot!idiotic(Idioten)", "\u91cf\u5b50 1a\x1cb"):
        assert m.places_of([None, t])[1].tolist() == X.buckets_of(t).tolist()


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 1, 0), (6, 1, None), (None, 1, 1), (1, 0, 1)], LABELS)
    out = X.toxicity(docs, labels).collect()
    assert len(out) == len(edge_rows())
    assert all(r["score"] is None and r["toxic"] is False for r in out if r["doc_id"] == 1)
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and set(CLASHING) <= set(kept.columns) and kept.where("text is null").count() == 2
    assert X.toxicity(empty_docs(spark), labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert X.drop_toxic(docs, none).count() == docs.count()  # nothing is toxic without labels
    same = [r["score"] for r in X.toxicity(docs.repartition(3), labels).orderBy("doc_id").collect()]
    assert same == [r["score"] for r in X.toxicity(docs, labels).orderBy("doc_id").collect()]


def test_all_of_a_planted_set_goes(spark):
    rows = sample(600, 5, lambda i, g: i and g)
    docs = docs_of(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:400]], LABELS)
    kept = {r["doc_id"] for r in X.drop_toxic(docs, labels).collect()}
    toxic, clean = {i for i, _, y in rows if y}, {i for i, _, y in rows if not y}
    assert len(kept & toxic) <= 0.05 * len(toxic) and len(kept & clean) >= 0.97 * len(clean)


def test_the_whole_query_against_loops(spark):
    """Scores of all documents from the fitted numbers, by plain loops over the terms and their pairs; the threshold; the labels that count."""
    import math

    from vellumkit.llm import queries as Q

    from ..oracle import SF

    d, l = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = X.train(d, l)
    weight = {int(b): (float(m.linear[k]), m.factors[k].tolist()) for k, b in enumerate(m.used)}
    got = {r["doc_id"]: r for r in Q.op2_toxicity(spark, SF).collect()}
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = {w for w in X.WORD.findall((r["text"] or "").lower())}
        terms = {t for w in words for t in [w, *(w[:k] + str(k) for k in (4, 5, 6) if len(w) >= k)]}
        mine = sorted({b for b in (X.xxhash.xxh3_64_intdigest(t) % X.BUCKETS for t in terms) if b in weight})
        z = m.bias + sum(weight[b][0] for b in mine) + sum(sum(x * y for x, y in zip(weight[a][1], weight[b][1])) for i, a in enumerate(mine) for b in mine[:i])
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=2e-6)
        assert got[r["doc_id"]]["toxic"] == (got[r["doc_id"]]["score"] >= X.THRESHOLD)
    truth = {r["doc_id"]: r["toxic"] for r in l.collect()}
    assert np.mean([got[i]["toxic"] == bool(t) for i, t in truth.items()]) > 0.9  # few labels, but it has learnt

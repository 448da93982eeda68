import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vellumkit.llm import license_scan as L, lm_scoring as Z, topk as K

from .common import docs_of, edge_docs, edge_rows, empty_docs, text

ROWS = "id bigint, terms array<int>, weights array<double>"


def brute(rows, k):
    out = set()
    for i, t, w in rows:
        q = dict(zip(t, w))
        scored = sorted(((-round(sum(q.get(a, 0.0) * b for a, b in zip(t2, w2)), 9), j) for j, t2, w2 in rows if j != i))[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("dense", [False, True])
def test_topk_against_brute_force(spark, dense):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        t = list(range(6)) if dense else sorted(rng.sample(range(40), rng.randint(0, 8)))
        rows.append((i * 3, t, [float(rng.randint(-3, 3)) for _ in t]))  # whole weights: many ties
    df = spark.createDataFrame(rows, ROWS)
    got = {(r["query_id"], r["neighbour_id"], r["rank"]) for r in K.exact_topk(df, df, 5, 7, 11).collect()}
    assert got == brute(rows, 5)


def test_topk_mixed_postings():
    """A term that all rows of a block have, and others that few have."""
    rng = np.random.default_rng(0)
    rows = [(i, [0, int(rng.integers(1, 9))], [1.0, float(rng.random())]) for i in range(50)]
    pack = lambda rs: (np.array([r[0] for r in rs]), np.cumsum([0, *(len(r[1]) for r in rs)]), np.array([x for r in rs for x in r[1]]), np.array([x for r in rs for x in r[2]]))
    got = {(int(a), int(b)) for q, c, s in K.block_topk(pack(rows), pack(rows), 4) for a, b in zip(q, c)}
    assert got == {(i, j) for i, j, _ in brute(rows, 4)}


def test_topk_rows_that_repeat(spark):
    """An id's least vector counts, whatever the order of the rows; a term's weights add up."""
    rows = [(1, [0, 1], [1.0, 1.0]), (2, [1], [3.0]), (2, [0], [2.0]), (2, [0], [5.0]), (3, [1, 1, 2], [1.0, 1.5, 9.0]), (4, None, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, ROWS).repartition(3)
        got = {(r["query_id"], r["neighbour_id"]): r["score"] for r in K.exact_topk(df, df, 3, 2, 2).collect()}
        assert got[1, 2] == 2.0 and got[1, 3] == got[3, 1] == 2.5 and got[2, 3] == got[4, 1] == 0.0 and len(got) == 12


def test_topk_blocks_are_bounded_in_bytes():
    import pyarrow as pa

    n = [3, 0, 500, 1, 2, 700, 4, 4, 4]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(n))), pa.array([list(range(x)) for x in n], pa.list_(pa.int32())), pa.array([[1.0] * x for x in n], pa.list_(pa.float64()))], names=["id", "terms", "weights"])
    for cut in (1, 4, 9):
        ids = [np.frombuffer(r["ids"][0].as_py(), np.int64).tolist() for r in K._blocks(4, 2000)(iter([b.slice(k, cut) for k in range(0, len(n), cut)]))]
        assert sum(ids, []) == list(range(len(n))) and all(len(x) == 1 or (len(x) <= 4 and sum(16 + 16 * n[i] for i in x) <= 2000) for x in ids)
        assert [2] in ids and [5] in ids and [6, 7, 8] in ids


def test_topk_edges(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [None, 2.0]), (5, [])], "vec_id bigint, embedding array<float>").withColumns({c: F.lit(0) for c in ("id", "terms", "weights", "norm", "v", "e")})
    got = K.embedding_neighbours(e, 10).collect()
    assert {r["query_id"] for r in got} == {1, 2, 3, 4, 5} and all(sum(x["query_id"] == q for x in got) == 4 for q in (1, 2, 3, 4, 5))
    assert [(r["neighbour_id"], r["score"]) for r in got if r["query_id"] == 3 and r["rank"] == 1] == [(4, 1.0)]
    assert K.embedding_neighbours(e.where("false")).count() == 0


def test_op5_asks_for_ids_divisible_by_50_among_all_rows(spark, tmp_path):
    from vellumkit.llm import queries as Q

    rng = np.random.default_rng(3)
    v = {int(i): rng.integers(-2, 3, 4).astype(float) + 0.25 for i in (*range(-60, 240), 10**12, 10**12 + 1)}
    rows = [(i, x.tolist()) for i, x in v.items()] + [(None, [1.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["neighbour_id"], r["rank"]) for r in Q.op5_exact_topk(spark, str(tmp_path)).collect()}
    unit = [(i, [0, 1, 2, 3], (x / np.sqrt(x @ x)).tolist()) for i, x in v.items()]
    assert {q for q, _, _ in got} == {-50, 0, 50, 100, 150, 200, 10**12}
    assert got == {x for x in brute(unit, K.K) if x[0] % 50 == 0}


def increasing_by_hand(pairs):
    best = 0
    for mask in range(1 << len(pairs)):
        s = [p[1] for k, p in enumerate(pairs) if mask >> k & 1]
        if all(a < b for a, b in zip(s, s[1:])):
            best = max(best, len(s))
    return best


def test_longest_increasing():
    rng = random.Random(1)
    for n in range(9):
        pairs = list(enumerate(rng.sample(range(20), n)))
        got = L.increasing(pairs)
        assert len(got) == increasing_by_hand(pairs) and all(a < b and x < y for (a, x), (b, y) in zip(got, got[1:]))


def test_alignment():
    a, b = "the quick brown fox jumps over the lazy dog".split(), "x the quick red fox y jumps over a lazy dog z".split()
    got = L.align(a, b)
    assert [a[i] for i, _ in got] == [b[j] for _, j in got] == ["the", "quick", "fox", "jumps", "over", "lazy", "dog"]
    assert L.align(a, a) == [(k, k) for k in range(len(a))] and L.align(a, []) == []


def test_licenses(spark):
    mit = L.TEMPLATES["mit"].split()
    line = L.TEMPLATES["apache-2.0-line"]
    cut = [w for k, w in enumerate(mit) if k % 9]  # one word in nine is gone
    rows = [(0, text(1)), (1, f"{text(2)}\n{line}\n{text(3)}"), (2, f"{text(4)} {' '.join(cut)} {text(5)}"), (3, " ".join(mit[::3])), (4, f"{line} {line} {text(6)} {line}"), (5, "license " * 5000), (6, f"// {' // '.join(mit)}".upper())]
    got = {(r["doc_id"], r["license"]): r for r in L.license_scan(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert set(got) == {(1, "apache-2.0-line"), (2, "mit"), (4, "apache-2.0-line"), (6, "mit")}
    r = got[1, "apache-2.0-line"]
    assert rows[1][1][r["start"] : r["end"]] == line.rstrip(".") and r["coverage"] == 1.0
    assert got[4, "apache-2.0-line"]["occurrences"] == 3 and got[6, "mit"]["coverage"] == 1.0
    assert got[2, "mit"]["coverage"] == pytest.approx(len(L.WORD.findall(" ".join(cut))) / len(L.WORD.findall(" ".join(mit))), abs=0.02)


def test_licenses_of_a_family_are_told_apart():
    ready = [L.Template.of(n, t) for n, t in L.TEMPLATES.items()]
    found = lambda t: {r[0] for r in L.scan(f"{text(1)} {t} {text(2)}", ready)}
    parts = {"bsd-3-clause": {"bsd-2-clause"}, "apache-2.0-header": {"apache-2.0-line"}}
    for name, t in L.TEMPLATES.items():
        assert found(t) == {name} | parts.get(name, set())
    assert found("Released under the License.") == found("Licensed under CC BY-NC 3.0.") == set()
    assert found("Licensed under the Apache License, Version 1.1.") == set()
    assert found("This work is licensed under the GNU General Public License, version 2. Chapter 3") == {"gpl-2-line"}
    assert found("Released under the BSD License. Released under the MIT License.") == {"bsd-line", "mit-line"}


def test_licenses_with_an_insertion_as_long_as_themselves():
    words = L.TEMPLATES["isc"].split()
    t, n = L.Template.of("isc", L.TEMPLATES["isc"]), len(words)
    for k in range(0, n + 7, 3):
        inserted = [*words[: n // 2], *(f"x{j}" for j in range(k)), *words[n // 2 :]]
        found = t.best(L.WORD.findall(" ".join(["a"] * 60 + inserted + ["z"] * 60).lower()))[0]
        assert found == (k <= len(t.words))


def any_window(t, words):
    """Whether any stretch of up to twice the template, wherever it starts, aligns enough."""
    for lo in range(len(words)):
        for hi in range(lo + 1, min(len(words), lo + 2 * len(t.words)) + 1):
            got = L.align(t.words, words[lo:hi])
            if len(got) >= t.need and 2 * len(got) >= got[-1][1] + 1 - got[0][1] and t.marked([(i, j + lo) for i, j in got], words):
                return True
    return False


def test_windows_against_all_stretches():
    """Templates with words left out, replaced and inserted, among words that repeat those of the template."""
    rng, found = random.Random(3), 0
    other = "the and of license software under copyright x1 x2 x3 permission notice".split()
    for name in ("mit-line", "cc-by-4.0", "gpl-3-line", "apache-2.0-line", "cc-by-nc-sa-4.0-line"):
        t = L.Template.of(name, L.TEMPLATES[name])
        noise = lambda n: [rng.choice(other + t.words) for _ in range(n)]  # noqa: B023, E731
        for _ in range(120):
            w = list(t.words)
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(w)), rng.random()
                w[at : at + (kind < 0.6)] = noise(0 if kind < 0.35 else 1 if kind < 0.6 else rng.randint(1, len(t.words)))
            words = noise(rng.randint(0, 6)) + w + noise(rng.randint(0, 6))
            assert (t.best(words)[0] > 0) == any_window(t, words)
            found += t.best(words)[0] > 0
    assert 300 < found < 560


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        assert L.Template.of("t", " ".join(a)).in_order(b) == n[-1][-1]


def test_the_whole_query_against_plain_python(spark):
    """Every document and template by ``best``, without the set operations that skip most; offsets and coverage from its places."""
    from vellumkit.llm import queries as Q

    from ..oracle import SF

    want = set()
    ready = [L.Template.of(n, t) for n, t in L.TEMPLATES.items()]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lower = (r["text"] or "").lower()
        spans = [m.span() for m in L.WORD.finditer(lower)]
        for t in ready:
            n, own = t.best([lower[a:b] for a, b in spans])
            if n:
                want.add((r["doc_id"], t.name, spans[own[0][1]][0], spans[own[-1][1]][1], len(own), round(len(own) / len(t.words), 6), n))
    assert {tuple(r) for r in Q.op7_license_scan(spark, SF).collect()} == want and want


def test_triggers_skip_nothing():
    """A text that covers a template enough always has a trigger."""
    rng = random.Random(2)
    for name, t in L.TEMPLATES.items():
        x = L.Template.of(name, t)
        for _ in range(30):
            drop = set(rng.sample(range(len(x.words)), len(x.words) - x.need))
            assert any(w in x.triggers for k, w in enumerate(x.words) if k not in drop)


def test_license_edges(spark):
    docs = edge_docs(spark)
    assert L.license_scan(docs).count() == 0 and L.license_scan(empty_docs(spark)).count() == 0
    odd = docs_of(spark, [(1, f"İİ {L.TEMPLATES['mit-line']}", "s")]).withColumn("doc_id", F.lit(None).cast("bigint"))
    (r,) = L.license_scan(odd).collect()
    assert r["doc_id"] is None and r["start"] == 3


def test_lm_scores_against_plain_python(spark):
    rng = random.Random(3)
    fine, poor = [f"fine{chr(97 + k)}word" for k in range(20)], [f"poor{chr(97 + k)}word" for k in range(20)]
    rows = [(i, " ".join(rng.choices(fine if i % 2 else poor, k=40))) for i in range(120)]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    good = docs.where("doc_id % 2 = 1 and doc_id < 60").select("doc_id")
    got = {r["doc_id"]: r for r in Z.lm_scores(docs, good).collect()}

    def dictionary(texts):
        n: dict[str, int] = {}
        for t in texts:
            for w in t.split():
                n[w] = n.get(w, 0) + 1
        best = sorted(n, key=lambda w: (-n[w] * (len(w) + 1), w))
        return (" " + " ".join(best[::-1]) + " ").encode()

    packs = [Z.compressor(dictionary([t for i, t in rows if i % 2 and i < 60])), Z.compressor(dictionary([t for _, t in rows]))]
    for i, t in rows:
        sizes = [len(c.compress(t.encode())) for c in packs]
        assert [got[i]["in_size"], got[i]["general_size"]] == sizes
        assert got[i]["score"] == pytest.approx((sizes[1] - sizes[0]) / sizes[1], abs=1e-6)
    mean = lambda k: np.mean([r["score"] for i, r in got.items() if i % 2 == k and i >= 60])
    assert mean(1) > mean(0)


def test_lm_dictionary_is_bounded(spark):
    counts = spark.range(5000).select(F.format_string("word%05d", "id").alias("word"), F.col("id").alias("n_in"))
    d = Z.dictionary(counts, "n_in", 1000)
    assert 900 < len(d) <= 1001 and d.split()[-1] == b"word04999"
    assert Z.dictionary(counts.where("false"), "n_in") == b""
    assert len(Z.compressor(b"").compress(b"abc")) == len(zstandard.ZstdCompressor(level=Z.LEVEL).compress(b"abc"))


def test_lm_dictionary_grows_with_the_vocabulary(spark):
    """Every word that was counted, rare and long ones too, is in the dictionary, and compresses by it."""
    counts = spark.range(60_000).select(F.sha1(F.col("id").cast("string")).alias("word"), F.col("id").alias("n_in")).where("n_in > 0")
    counts = counts.unionByName(spark.createDataFrame([("x" * 3000, 1)], "word string, n_in bigint"))
    d = Z.dictionary(counts, "n_in")
    want = sorted(((r["n_in"] * (len(r["word"]) + 1), r["word"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
    assert d.decode().split(" ") == ["", *(w for _, w in want[::-1]), ""]
    rare = " ".join(w for _, w in want[-2:-40:-1])
    assert 3 * len(Z.compressor(d).compress(rare.encode())) < len(Z.compressor(b"").compress(rare.encode()))


def test_lm_dictionary_passes_over_what_does_not_fit(spark):
    counts = spark.createDataFrame([("a" * 2000, 9), ("b" * 700, 9), ("c" * 600, 8), ("e" * 250, 19), ("f", 1)], "word string, n_in bigint")
    assert Z.dictionary(counts, "n_in", 1000).split() == [b"e" * 250, b"b" * 700]


def test_lm_words_at_the_start_of_a_large_dictionary_count():
    """zstandard's faster match finders would only see the last 16 MB."""
    names = [b"w%08x" % (k * 2654435761 % 2**32) for k in range(2_200_000)]
    c = Z.compressor(b" ".join([b"", *names, b""]))
    first, last, none = b" ".join(names[5:2000:4]), b" ".join(names[-2000::4]), b" ".join(b"w%08x" % (k * 40503 % 2**32 ^ 0x5A5A5A5A) for k in range(499))
    assert Z.size_of(first, c) < 0.85 * Z.size_of(none, c) and Z.size_of(last, c) < 0.85 * Z.size_of(none, c)


def test_lm_whole_texts_of_any_length():
    c = Z.compressor(b" alpha beta gamma delta words of a dictionary ")
    t = text(3, 40_000).encode()
    assert Z.size_of(t, c) == sum(len(c.compress(t[a : a + Z.CHUNK])) for a in range(0, len(t), Z.CHUNK)) > len(t) // 3
    assert Z.size_of(b"", c) == len(c.compress(b""))


def test_lm_repeated_rows_and_texts(spark):
    """Rows of one id with several texts, of one text with several ids, and equal rows: each keeps its own sizes, as often as it occurs."""
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (2, text(1)), (None, text(2)), (None, text(2)), (3, None), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string").repartition(3)
    good = spark.createDataFrame([(2,)], "doc_id bigint")
    counts = Z.word_counts(docs, good)
    packs = [Z.compressor(Z.dictionary(counts, c)) for c in ("n_in", "n_all")]
    want = sorted(str((i, *(None if t is None else Z.size_of(t.encode(), c) for c in packs))) for i, t in rows)
    assert sorted(str((r["doc_id"], r["in_size"], r["general_size"])) for r in Z.lm_scores(docs, good).collect()) == want


def test_lm_edges(spark):
    docs = edge_docs(spark)
    good = spark.createDataFrame([(5,), (5,), (None,), (77,)], "doc_id bigint")
    out = Z.lm_scores(docs, good).collect()
    assert len(out) == len(edge_rows())
    assert all(r["score"] is None and r["in_size"] is None for r in out if r["doc_id"] == 1)
    assert Z.lm_scores(docs, good.where("false")).where("score is not null").count() == 10
    assert Z.lm_scores(empty_docs(spark), good).count() == 0
    n = {r["word"]: r["n_all"] for r in Z.word_counts(docs_of(spark, [(1, "a b a", "s"), (2, "a", "s")]), good).collect()}
    assert n == {"a": 3, "b": 1}

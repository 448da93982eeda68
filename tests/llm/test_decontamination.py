import random
import re

from vellumkit.llm import decontamination as D

from .common import CLASHING, docs_of, edge_docs, empty_docs, text

ITEMS = "item_id bigint, text string"


def brute_force(docs, items, ngram=D.NGRAM, min_words=D.MIN_WORDS):
    """(doc, item, start, end) by comparing every run of words with every run of every item."""
    out = set()
    for i, t in docs:
        spans = [(m.group().lower(), *m.span()) for m in re.finditer(r"\w+", t)]
        for item, x in items:
            w = re.findall(r"\w+", x.lower())
            if len(w) < min_words:
                continue
            n = min(ngram, len(w))
            runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            hit = [k for k in range(len(spans) - n + 1) if tuple(s[0] for s in spans[k : k + n]) in runs]
            while hit:
                a = b = hit.pop(0)
                while hit and hit[0] <= b + n:
                    b = hit.pop(0)
                out.add((i, item, spans[a][1], spans[b + n - 1][2]))
    return out


def test_against_brute_force(spark):
    items = [(k, text(200 + k, 8 + 4 * k).capitalize() + "?") for k in range(8)] + [(90, "too short"), (91, text(205, 28))]
    docs = [(0, text(1, 80)), (1, f"{text(2)} -- {items[2][1].upper()}! {text(3)}"), (2, items[5][1]), (3, f"{text(4)}\n" + items[6][1].replace(" ", ",  ") + text(5)), (4, " ".join(items[7][1].split()[3:20])), (5, f"{items[3][1]} {text(6)} {items[3][1]}"), (6, " ".join(items[7][1].split()[:9]))]
    got = D.contamination(docs_of(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in got} == brute_force(docs, items)
    assert {r["coverage"] for r in got if r["doc_id"] == 2} == {1.0}
    kept = D.drop_contaminated(docs_of(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, ITEMS))
    assert {r["doc_id"] for r in kept.collect()} == {0, 6}


def test_offsets_with_letters_that_grow():
    item = "one two three four five six seven eight nine ten"
    t = f"İİ ß {item.upper()} İ"
    (found,) = D.Items([(1, item)]).matches(t)
    assert t[found[1] : found[2]].lower() == item


def test_edges(spark):
    docs = edge_docs(spark)
    leak = docs.where("doc_id = 5").first()["text"]
    items = spark.createDataFrame([(1, leak), (1, leak), (2, None), (None, leak), (3, ""), (4, text(4))], ITEMS)
    assert [i for i, _ in D._sent(items, 10, 5, 24)[1].value[0]] == [1, 3, 4]
    got = D.contamination(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(4, 4), (5, 1), (5, 1)]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and set(CLASHING) <= set(kept.columns) and kept.count() == docs.count() - 3
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination(docs, none).count() == 0 and D.drop_contaminated(docs, none).count() == docs.count()
    assert D.contamination(empty_docs(spark), items).count() == 0


def test_runs_of_any_cut_against_brute_force():
    """Few different words, so that runs of all lengths start anywhere, overlap and repeat."""
    rng = random.Random(5)
    for ngram in (1, 2, 3, 5, 6):
        items = [(k, " ".join(rng.choices("abc", k=rng.randint(1, 14)))) for k in range(6)]
        found = D.Items(items, ngram, 1, 0)
        for i in range(60):
            t = " ".join(rng.choices("abcd", k=rng.randint(0, 30)))
            assert {(i, *m[:3]) for m in found.matches(t)} == brute_force([(i, t)], items, ngram, 1)


def test_an_item_id_with_two_texts(spark):
    long, short = text(31, 40), text(32, 7)
    items = spark.createDataFrame([(1, long), (1, short)], ITEMS)
    got = D.contamination(docs_of(spark, [(1, f"{text(33)} {short}", "s"), (2, f"{long} {text(34)}", "s")]), items).collect()
    assert sorted((r["doc_id"], r["n_words"], r["coverage"]) for r in got) == [(1, 7, 1.0), (2, 40, 1.0)]


def test_short_items(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "Antidisestablishmentarianism rules"), (3, "量子もつれは光速を超えて情報を伝えることはできない"), (4, "four short plain words")], ITEMS)
    docs = docs_of(spark, [(1, "yes four short plain words", "s"), (2, f"{text(1)}, antidisestablishmentarianism rules. {text(2)}", "s"), (3, "前置き、量子もつれは光速を超えて情報を伝えることはできない。", "s"), (4, "antidisestablishmentarianism ruled", "s"), (5, "量子の話", "s")])
    got = {(r["doc_id"], r["item_id"]): r for r in D.contamination(docs, items).collect()}
    assert set(got) == {(2, 2), (3, 3)} and (got[3, 3]["start"], got[3, 3]["end"], got[3, 3]["coverage"]) == (4, 29, 1.0)
    assert {r["item_id"] for r in D.contamination(docs, items, min_words=1).collect()} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in D.drop_contaminated(docs, items).collect()} == {1, 4, 5}


def test_very_long_text(spark):
    item = text(41, 30)
    docs = docs_of(spark, [(1, f"{text(42, 120_000)} {item} {text(43, 10)}", "s"), (2, text(42, 120_000), "s")])
    assert [r["doc_id"] for r in D.contamination(docs, spark.createDataFrame([(1, item)], ITEMS)).collect()] == [1]

import itertools

import numpy as np

from vellumkit.llm import simhash as S

from .common import CLASHING, docs_of, edge_docs, edited, empty_docs, text


def groups_by_brute_force(docs, radius=S.RADIUS):
    """Connected components over all pairs within the radius."""
    sig = {i: S.signature(t)[0] for i, t in docs}
    label = {i: i for i in sig}
    for a, b in itertools.combinations(sorted(sig), 2):
        if np.bitwise_count(sig[a] ^ sig[b]).sum() <= radius and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    return label


def corpus():
    rows = []
    for g in range(30):
        base = text(100 + g, 30 + 9 * g)
        rows += [base] + [base] * (g % 3) + [edited(base, 1000 + 10 * g + k, 0.02 * (k + 1)) for k in range(g % 5)]
    boiler = text(99, 55)
    rows += [f"{text(500 + k, 120)} {boiler} {text(600 + k, 60)}" for k in range(25)]
    return list(enumerate(rows))


def test_recall_and_precision_against_all_pairs(spark):
    docs = corpus()
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in docs])).collect()}
    want = groups_by_brute_force(docs)
    found = sum(got[i] == got[w] for i, w in want.items() if i != w)
    assert found >= 0.9 * sum(i != w for i, w in want.items())
    assert all(want[i] == want[g] for i, g in got.items())  # no group that all pairs don't give
    clean = [i for i, _ in docs[-25:]]
    assert all(got[i] == i for i in clean)  # a shared passage is no copy


def test_near_copies_are_found(spark):
    base = text(7, 300)
    docs = docs_of(spark, [(0, base, "s"), *[(k, edited(base, k, 0.01 * k), "s") for k in range(1, 7)]])
    assert {r["group_id"] for r in S.near_duplicates(docs).collect()} == {0}


def test_an_anchor_that_many_have_is_cut(spark):
    """With cells of any size every pair of a hot anchor still meets: the groups are those of one shard."""
    shared = [f"{text(7, 300)} {text(800 + k, 12)}" for k in range(60)]
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate([*shared, *(text(900 + k, 90) for k in range(20)), *shared[:30]])])
    groups = lambda cell: sorted(tuple(r) for r in S.near_duplicate_groups(docs, cell=cell).collect())
    assert groups(1) == groups(7) == groups(1 << 14) and len(groups(7)) >= 89 - 20
    rng = np.random.default_rng(2)
    rows = [(k, *(int(x) for x in rng.integers(0, 9, S.LANES)), [1, 2] if k % 3 else [1]) for k in range(50)]
    found = spark.createDataFrame(rows, ", ".join(["doc_id long", *(f"{h} long" for h in S.HASH), "anchors array<long>"]))
    for cell in (5, 50):
        met = {(a["doc_id"], b["doc_id"]) for own in [S._shards(found, cell).collect()] for a in own for b in own if a["shard"] == b["shard"]}
        assert met == {(a, b) for a in range(50) for b in range(50)}


def test_of_rows_that_repeat_an_id_the_least_stays(spark):
    rows = [(1, text(1), "b"), (1, text(1), "a"), (1, text(2), "a"), (2, text(3), "a")]
    want = min(t for i, t, _ in rows if i == 1)
    for order in (rows, rows[::-1]):
        got = S.drop_near_duplicates(docs_of(spark, order).repartition(3)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, want), (2, text(3))]
        assert want != text(1) or [r["source"] for r in got if r["doc_id"] == 1] == ["a"]


def test_large_group_of_copies(spark):
    base = text(8, 200)
    docs = docs_of(spark, [(k, base if k % 2 else edited(base, k, 0.03), "s") for k in range(1500)])
    kept = S.drop_near_duplicates(docs).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_tree_search_is_exhaustive():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, (400, S.LANES), dtype=np.uint64)
    for k in range(0, 400, 5):  # near pairs
        h[k + 1] = h[k]
        h[k + 1, 0] ^= np.uint64((1 << int(rng.integers(0, 60))) - 1)
    shard = np.sort(rng.integers(0, 6, 400))
    got = S.tree_components(shard, h, 44, chunk=2000)
    want = np.arange(400)
    near = [(a, b) for a in range(400) for b in range(a) if shard[a] == shard[b] and np.bitwise_count(h[a] ^ h[b]).sum() <= 44]
    for _ in range(20):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert (got == want).all()


def test_batches_split_anywhere():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    shard = np.sort(rng.integers(0, 9, 90))
    h = rng.integers(0, 4, (90, S.LANES)).astype(np.int64)
    t = pa.table([pa.array(shard), pa.array(np.arange(90)), *(pa.array(h[:, j]) for j in range(S.LANES))], names=["anchor", "doc_id", *(f"h{j}" for j in range(S.LANES))])
    edges = lambda n: sorted(tuple(r.values()) for b in S._search(iter(t.to_batches(max_chunksize=n)), 3) for r in b.to_pylist())
    assert edges(90) == edges(7) == edges(1) and edges(90)


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["doc_id"]: r["group_id"] for r in S.connected_components(spark.createDataFrame(path, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {200: 100, 300: 100}


def test_edges(spark):
    docs = edge_docs(spark)
    rows = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    assert set(rows) == {None, 1, 2, 3, 4, 5, 6, 7, 8, -9}
    assert all(r["kept"] for r in rows.values())
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and set(CLASHING) <= set(kept.columns)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", "1", "2", "3", "4", "5", "6", "7", "8", "-9"])  # one of the two rows 5
    assert S.near_duplicates(empty_docs(spark)).count() == 0 and S.drop_near_duplicates(empty_docs(spark)).count() == 0


def test_equal_texts_without_words(spark):
    docs = docs_of(spark, [(1, "", "s"), (2, "", "s"), (3, " ", "s"), (4, "!!!", "s"), (5, "!!!", "s")])
    assert {r["doc_id"] for r in S.drop_near_duplicates(docs).collect()} == {1, 3, 4}

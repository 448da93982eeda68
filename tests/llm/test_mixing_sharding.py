import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumkit.llm import mixing as M, sharding as S

from ..oracle import SF, connect, rows
from .common import CLASHING, edge_docs, empty_docs

SIZES = {"hot": 2000, "a": 300, "b": 290, None: 70, "one": 1}


def docs(spark):
    out = None
    for k, (s, n) in enumerate(SIZES.items()):
        d = spark.range(k * 10_000, k * 10_000 + n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(s).cast("string").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
        out = d if out is None else out.unionByName(d)
    return out


WEIGHTS = {"hot": 2.0, "a": 1.0, "b": 0.5, "one": 0.0}


def test_quotas_meet_the_weights():
    q = M.quotas(SIZES, WEIGHTS, 0.25, 8)
    assert "one" not in q and all(8 * (n - 1) < SIZES[s] for s, n in q.items())
    total = sum(q.values())
    for s, n in q.items():
        w = WEIGHTS.get(s, 0.25)
        assert abs(n - total * w / 3.75) <= 1.5
    assert M.quotas({}, WEIGHTS) == {} and M.quotas({"x": 5}, {"x": 0.0}) == {}


def test_scarce_sources_do_not_size_the_mixture():
    assert M.quotas({"hot": 2000, "one": 1}, {}, 1.0, 8) == {"hot": 250, "one": 1}
    assert M.quotas({"hot": 2000, **{f"tail{k}": 1 for k in range(50)}}, {"hot": 0.5}, 1.0, 8)["hot"] == 250
    even = {"src0": 94_683, **{f"src{k}": 8512 for k in range(1, 20)}}
    before = M.quotas(even)
    for n in (1, 3, 200):
        assert M.quotas({**even, None: n}) == {**before, None: -(-n // M.BLOCK)}
    for n in (1, 200, 2000, 3000, 5000, 8000):  # at least SCARCE of the rows stay, but for the blocks' rounding
        assert sum(M.quotas({**even, None: n}).values()) * M.BLOCK >= M.SCARCE * (sum(even.values()) + n) - 21 * M.BLOCK


def test_tree_deals_exactly():
    quota = [100, 37, 3, 0, 61]
    c = M.Tree(quota, 9, 1).counts()
    assert c.sum(axis=0).tolist() == quota and np.ptp(c.sum(axis=1)) <= 4
    assert (c == M.Tree(quota, 9, 1).counts()).all() and (c != M.Tree(quota, 9, 2).counts()).any()
    # the mean of many draws is the proportional share
    mean = np.mean([M.Tree([40, 20], 4, s).counts() for s in range(300)], axis=0)
    assert np.allclose(mean, [[10, 5]] * 4, atol=0.4)


def test_draws_of_any_size():
    rng = np.random.default_rng(0)
    x = M.Tree._draw(rng, 4 * 10**11, 6 * 10**11, 10**10)
    assert abs(x - 4 * 10**9) < 10**6


@pytest.mark.parametrize("good,bad,want", [(9, 4, 5), (3, 50, 20), (40, 1, 30), (10**9, 10**9, 400_000), (3 * 10**9, 10**9, 3_999_900_000)])
def test_draws_by_inversion_have_the_right_probabilities(good, bad, want):
    """Chi-square against the probabilities from binomial coefficients (log-gamma for large ones)."""
    lo, hi = max(0, want - bad), min(good, want)
    mean, sd = want * good / (good + bad), (want * good * bad * (good + bad - want) / (good + bad) ** 2 / (good + bad - 1)) ** 0.5
    lo, hi = max(lo, int(mean - 9 * sd)), min(hi, int(mean + 9 * sd) + 1)
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = np.array([ln(good, k) + ln(bad, want - k) for k in range(lo, hi + 1)])
    p = np.exp(p - p.max())
    cuts = np.searchsorted(np.cumsum(p) / p.sum(), np.arange(1, 12) / 12)
    part = np.bincount(np.searchsorted(cuts, np.arange(len(p)), side="left"), p, 13)
    n = 4000
    x = np.array([M.inverse(u, good, bad, want, 512) for u in np.random.default_rng(5).random(n)])
    assert lo <= x.min() and x.max() <= hi
    got, due = np.bincount(np.searchsorted(cuts, x - lo, side="left"), minlength=13), n * part / part.sum()
    assert ((got - due)[due > 0] ** 2 / due[due > 0]).sum() < 35  # 0.9995 of chi-square with 12 degrees
    if hi - lo < 40:  # each outcome has its own probability
        for k, q in zip(range(lo, hi + 1), p / p.sum()):
            assert abs((x == k).mean() - q) < 4.5 * (q * (1 - q) / n) ** 0.5 + 1e-9


def test_large_trees_deal_exactly():
    t = M.Tree([3 * 10**9, 10**9, 7], 4, 1)
    left = t.left(0, 4, t.quota)
    assert left.sum() == t.quota.sum() // 2 and (left >= 0).all() and (left <= t.quota).all()
    assert t.shard_of(0, np.array([0, 3 * 10**9 - 1])).tolist() == [0, 3]


def test_mixture_without_the_tree(spark):
    """The whole query by plain recursion: halves of the shards get a draw for each source, from a generator seeded by the node."""
    d = docs(spark)
    quota = M.quotas(SIZES, WEIGHTS, 0.25, 8)
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    dealt: dict[int, list[int]] = {}

    def deal(lo, hi, here):
        if hi - lo == 1:
            dealt[lo] = here
            return
        mid, total = (lo + hi) // 2, sum(here)
        rng, want, rest, left = np.random.default_rng([M.SEED, lo, hi]), total * ((lo + hi) // 2 - lo) // (hi - lo), total, []
        for n in here:
            rest -= n
            left.append(int(rng.hypergeometric(n, rest, want)) if n and want and rest else want if n and want else 0)
            want -= left[-1]
        deal(lo, mid, left)
        deal(mid, hi, [a - b for a, b in zip(here, left)])

    deal(0, -(-sum(quota.values()) // 32), [quota[s] for s in names])
    key = lambda seed: {r["doc_id"]: r["k"] for r in d.select("doc_id", M.mixed_key("doc_id", seed).alias("k")).collect()}
    first, second, want = key(M.SEED), key(M.SEED + 1), {}
    for k, s in enumerate(names):
        ids = sorted((r["doc_id"] for r in d.where(F.col("source").eqNullSafe(s)).select("doc_id").collect()), key=lambda i: (first[i], i))
        blocks = iter([ids[a : a + 8] for a in range(0, len(ids), 8)])
        for shard in sorted(dealt):
            want |= {i: shard for _ in range(dealt[shard][k]) for i in next(blocks)}
    place = {}
    for shard in dealt:
        place |= {i: p for p, i in enumerate(sorted((i for i in want if want[i] == shard), key=lambda i: (second[i], i)))}
    got = M.mixture(d, WEIGHTS, 0.25, 8, 32).collect()
    assert {r["doc_id"]: (r["shard"], r["position"]) for r in got} == {i: (want[i], place[i]) for i in want}


def test_a_stray_row_does_not_size_the_mixture():
    assert M.quotas({"a": 10**6, "b": 10**6, None: 1}, {}) == {"a": 62_500, "b": 62_500, None: 1}
    q = M.quotas({"src0": 10**9, "src3": 10**9, "src4": 10**9, None: 1})
    assert sum(q.values()) * M.BLOCK > 0.99 * 2 * 10**9  # all that weights of 2, 1 and 1 allow


def test_mixture_against_brute_force(spark):
    d = docs(spark)
    got = M.mixture(d, WEIGHTS, 0.25, 8, 32).toPandas()
    quota = M.quotas(SIZES, WEIGHTS, 0.25, 8)
    assert got["doc_id"].is_unique
    counts = got.assign(source=got["source"].fillna("~")).groupby("source").size().to_dict()
    assert counts == {(s or "~"): min(n * 8, SIZES[s]) for s, n in quota.items()}
    # by hand: order each source by its key, cut blocks, deal the blocks out in order by the tree's counts
    key = {r["doc_id"]: r["k"] for r in d.select("doc_id", M.mixed_key("doc_id", M.SEED).alias("k")).collect()}
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    tree = M.Tree([quota[s] for s in names], -(-sum(quota.values()) // 32))
    per, want = tree.counts(), {}
    for k, s in enumerate(names):
        ids = sorted((r["doc_id"] for r in d.where(F.col("source").eqNullSafe(s)).select("doc_id").collect()), key=lambda i: (key[i], i))
        block = 0
        for shard, n in enumerate(per[:, k]):
            for i in ids[block * 8 : (block + n) * 8]:
                want[i] = shard
            block += n
    assert dict(zip(got["doc_id"], got["shard"])) == want
    for _, own in got.groupby("shard"):
        assert sorted(own["position"]) == list(range(len(own)))
    mixed = M.mix(d, WEIGHTS, 0.25, 8)
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} == set(got["doc_id"])


def in_order(ids, places):
    """Whether rows that follow each other hold whole shards, each in the order of its positions."""
    at = [places[i] for i in ids]
    starts = [s for k, (s, _) in enumerate(at) if not k or at[k - 1][0] != s]
    return len(starts) == len(set(starts)) and all(a[0] != b[0] or b[1] == a[1] + 1 for a, b in zip(at, at[1:]))


def test_mix_lays_rows_out_as_the_tree_deals_them(spark, tmp_path):
    import corpus_pipeline as C
    import pyarrow.parquet as pq

    d = docs(spark).withColumns({c: F.lit("x") for c in CLASHING})
    for n, (made, mixture) in enumerate(((M.mix(d, WEIGHTS, 0.25, 8, 4), M.mixture(d, WEIGHTS, 0.25, 8, 4)), (C.mix_sources(spark, d, ""), M.mixture(d)))):
        places = {r["doc_id"]: (r["shard"], r["position"]) for r in mixture.collect()}
        made.write.parquet(f"{tmp_path}/{n}")
        files = [pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist() for f in (tmp_path / f"{n}").glob("*.parquet")]
        assert sorted(sum(files, [])) == sorted(places) and all(in_order(ids, places) for ids in files)
        shards = [{places[i][0] for i in ids} for ids in files]
        assert sum(map(len, shards)) == len(set().union(*shards)) == len({s for s, _ in places.values()})


def test_large_ids_beside_a_null_one_are_exact(spark):
    big = [2**60 + k for k in range(1, 40)]
    d = spark.createDataFrame([(i, "t", "en", "a", 1) for i in [None, *big]], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    assert {r["doc_id"] for r in M.mixture(d).collect()} == {None, *big} == {r["doc_id"] for r in M.mix(d).collect()}


def test_mixing_edges(spark):
    d = edge_docs(spark)
    out = M.mix(d, {"a": 1.0}, 1.0, 2)
    assert out.columns == d.columns and set(CLASHING) <= set(out.columns)
    assert out.where("doc_id = 5").count() in (0, 2)
    assert M.mixture(d, {"a": 1.0}, 1.0, 2).groupBy("doc_id").count().where("count > 1").count() == 0
    assert M.mixture(empty_docs(spark)).count() == 0 and M.mix(empty_docs(spark)).count() == 0
    assert M.mix(d, {}, 0.0).count() == 0


def test_sharding_is_proportional(spark):
    got = S.shard_assignment(docs(spark), 200).toPandas()
    n = sum(SIZES.values())
    sizes = got.groupby("shard").size()
    assert len(sizes) == -(-n // 200) and sizes.max() - sizes.min() <= 1
    for s, m in SIZES.items():
        own = got[got["source"].isna() if s is None else got["source"] == s].groupby("shard").size().reindex(sizes.index, fill_value=0)
        assert (abs(own - sizes * m / n) <= 2).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["position"]) == list(range(len(own)))


@pytest.mark.parametrize("name", ["op1_url_filter", "op5_exact_topk", "op8_sharding"])
def test_matches_sql(spark, name):
    from vellumkit.llm import queries as Q

    mine, theirs = Q.queries()[name](spark, SF).toPandas(), connect().sql(Q.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)


def test_sharding_edges(spark):
    d = edge_docs(spark)
    out = S.shard(d, 4)
    assert out.columns == [c for c in d.columns if c != "shard"] + ["shard", "position"] and out.count() == d.count()
    assert out.where("doc_id = 5").select("shard", "position").distinct().count() == 1
    assert S.shard_assignment(empty_docs(spark)).count() == 0 and S.shard(empty_docs(spark)).count() == 0

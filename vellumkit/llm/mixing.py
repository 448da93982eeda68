"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is put in a seeded order and cut into blocks of ``block`` documents. With target weights w, source s gives
its exact quota of T * w_s blocks, with the largest T that no source exceeds but the scarce ones. A scarce source gives all
it has and doesn't size the mixture: it has less than ``SCARCE`` of what its weight is of the rows of the sources that
aren't scarcer. So ``SCARCE`` of the rows are kept at least, whatever the tail. A splitting tree deals the quotas out to the output shards: at a node over m shards, the left
m // 2 of them get their share of the blocks, and how many of each source is one draw from the multivariate
hypergeometric distribution, from a generator seeded by the node. So the leaves' counts add up to the quotas exactly,
and each shard draws the next blocks of each source's permuted order: disjoint, and none left over. Within a
shard the documents are shuffled by a key.

A node is drawn from its seed alone, so each task walks only the nodes on the way to its own blocks; nothing of
the tree is collected. Ids, sources and keys are shuffled by range; ``mix`` then moves the drawn texts to their shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import mixed_key, rank_within
from ..runtime import checkpoint, join_checked, prepare
from .sharding import sources_of

#: Target weight of a source: by name, ``REST`` for any other. Weights are relative.
WEIGHTS, REST = {"src0": 2.0, "src1": 0.5, "src2": 0.5}, 1.0
BLOCK, SHARD_BLOCKS, SEED = 16, 128, 29
SCARCE = Fraction(1, 3)


def quotas(counts: dict[str | None, int], weights: dict[str, float] = WEIGHTS, rest: float = REST, block: int = BLOCK) -> dict[str | None, int]:
    """Blocks that each source gives. A source of weight 0 gives none, as does one without rows; a source's last block
    may be short. The sources that aren't scarce share their blocks by weight, each within one block; scarce ones give all."""
    weight = {s: Fraction(str(weights.get(s, rest) if s is not None else rest)) for s, n in counts.items() if n > 0}
    weight = {s: w for s, w in weight.items() if w > 0}
    if not weight:
        return {}
    have, scarce = {s: -(-counts[s] // block) for s in weight}, set()
    # scarcest first: one that has too little of its part of the rows that are left is fixed, the rest is shared without it
    rows, parts = sum(counts[s] for s in weight), sum(weight.values())
    for s in sorted(weight, key=lambda s: counts[s] / weight[s]):
        if counts[s] * parts >= SCARCE * rows * weight[s]:
            break
        rows, parts = rows - counts[s], parts - weight[s]
        scarce.add(s)
    t = min(Fraction(have[s]) / w for s, w in weight.items() if s not in scarce)
    return {s: have[s] if s in scarce else min(have[s], max(1, int(t * w))) for s, w in weight.items()}


def inverse(u: float, good: int, bad: int, want: int, step: int = 1 << 16) -> int:
    """The hypergeometric draw at ``u`` in [0, 1), by inversion, for populations of any size.

    Weights relative to the mode follow from the exact ratio of neighbours, in both directions until they vanish in a double, so about
    80 standard deviations of them. They are summed outwards from the mode, which orders the outcomes in another way than by size
    but gives each its own probability.
    """
    least, most = max(0, want - bad), min(good, want)
    mode = min(max((good + 1) * (want + 1) // (good + bad + 2), least), most)
    tails: list[tuple[int, int, np.ndarray]] = [(mode, 1, np.ones(1))]
    for way in (1, -1):
        at, level = mode, 0.0
        while level > -800 and (n := min(step, (most - at) if way > 0 else (at - least))):
            k = np.arange(n, dtype=np.float64)
            if way > 0:  # p(x + 1) / p(x) for x = at, at + 1, ...
                up, down = (good - at - k) * (want - at - k), (at + 1 + k) * (bad - want + at + 1 + k)
            else:  # p(x - 1) / p(x) for x = at, at - 1, ...
                up, down = (at - k) * (bad - want + at - k), (good - at + 1 + k) * (want - at + 1 + k)
            logs = level + np.cumsum(np.log(up) - np.log(down))
            tails.append((at + way, way, np.exp(logs)))
            at, level = at + way * n, float(logs[-1])
    left = u * float(np.sum([t.sum() for _, _, t in tails]))
    for start, way, t in tails:
        if left < (total := float(t.sum())):
            return start + way * min(int(np.searchsorted(np.cumsum(t), left, side="right")), len(t) - 1)
        left -= total
    return mode


class Tree:
    """Splitting tree of quotas (in a fixed order of sources) over ``shards`` shards."""

    def __init__(self, quota: list[int], shards: int, seed: int = SEED):
        self.quota, self.shards, self.seed = np.array(quota, np.int64), shards, seed
        self.lefts: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, here: np.ndarray) -> np.ndarray:
        """Blocks of each source that go to the left half of the shards [lo, hi), of the blocks ``here``."""
        if (found := self.lefts.get((lo, hi))) is None:
            if len(self.lefts) > 4096:
                self.lefts.clear()
            total, mid = int(here.sum()), (lo + hi) // 2
            share = total * (mid - lo) // (hi - lo)
            rng = np.random.default_rng([self.seed, lo, hi])
            found, rest, want = np.zeros_like(here), total, share
            for s, n in enumerate(here):  # one hypergeometric draw a source: a multivariate draw without its limit on size
                rest -= int(n)
                found[s] = got = self._draw(rng, int(n), rest, want)
                want -= got
            self.lefts[lo, hi] = found
        return found

    @staticmethod
    def _draw(rng: np.random.Generator, good: int, bad: int, want: int) -> int:
        if want == 0 or good == 0:
            return 0
        if bad == 0:
            return want
        if good + bad < 10**9:  # what the generator takes
            return int(rng.hypergeometric(good, bad, want))
        return inverse(float(rng.random()), good, bad, want)

    def shard_of(self, source: int, blocks: np.ndarray) -> np.ndarray:
        """Shard of each block number of a source; the numbers are below its quota."""
        out = np.empty(len(blocks), np.int64)
        todo = [(0, self.shards, self.quota, np.arange(len(blocks)), np.asarray(blocks, np.int64))]
        while todo:
            lo, hi, here, rows, at = todo.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            left, mid = self.left(lo, hi, here), (lo + hi) // 2
            first = at < left[source]
            todo.append((lo, mid, left, rows[first], at[first]))
            todo.append((mid, hi, here - left, rows[~first], at[~first] - left[source]))
        return out

    def counts(self) -> np.ndarray:
        """[shards, sources]: blocks of each source in each shard (for tests)."""
        return np.stack([np.bincount(self.shard_of(s, np.arange(q)), minlength=self.shards) for s, q in enumerate(self.quota)], axis=1)


def _plan(docs: DataFrame, weights: dict[str, float], rest: float, block: int, seed: int) -> tuple[DataFrame, dict[str | None, int]]:
    """Documents with their rank in their source, and the quotas. A count for each source comes to the driver, and a node of
    the tree has a number for each: thousands of sources are fine, a source for each web domain isn't meant."""
    prepare(docs.sparkSession)
    ids = sources_of(docs, seed)
    counts = {r["source"]: r["n"] for r in ids.groupBy("source").agg(F.count("*").alias("n")).collect()}
    return rank_within(ids, "source", ["key", "doc_id"]), quotas(counts, weights, rest, block)


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = REST, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, shard, position) of the documents in the mixture; there are ceil(blocks / shard_blocks) shards.

    Rows that repeat a doc_id are one document, with its least source; null doc_ids are one document too; a null source is a
    source of its own, of weight ``rest``. An empty table gives no rows. Other columns are not read.
    """
    ranked, quota = _plan(docs, WEIGHTS if weights is None else weights, rest, block, seed)
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    sizes = [quota[s] for s in names]
    shards = max(1, -(-sum(sizes) // shard_blocks))
    place = {s: k for k, s in enumerate(names)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(sizes, shards, seed)
        for b in batches:
            coded = b["source"].dictionary_encode(null_encoding="encode")
            codes, at, shard = coded.indices.to_numpy(), b["rank"].to_numpy() // block, np.full(b.num_rows, -1, np.int64)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                if name in place:
                    own = np.flatnonzero((codes == code) & (at < sizes[place[name]]))
                    shard[own] = tree.shard_of(place[name], at[own])
            # ids stay in Arrow: beside a null, pandas would make them floats
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(shard)], names=["doc_id", "source", "shard"]).filter(pa.array(shard >= 0))

    dealt = ranked.select("doc_id", "source", "rank").mapInArrow(deal, "doc_id bigint, source string, shard bigint")
    dealt = dealt.withColumn("key", mixed_key("doc_id", seed + 1))
    return rank_within(dealt, "shard", ["key", "doc_id"], "position").select("doc_id", "source", "shard", "position")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = REST, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are in ``mixture``, with all their columns, whatever their names, laid out as the tree deals them: each shard
    of the mixture in one partition and in the order of its positions. Rows that repeat a doc_id are kept or dropped together and share its
    place, as do those of a null doc_id; a null source is a source of its own; nulls in other columns and texts of any length don't
    matter. An empty table stays empty.

    Texts are shuffled once, to their shards, while the places fit the checked broadcast; beyond it once more, by doc_id.
    """
    doc, shard, position = (min(n for n in (f"__{x}{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("doc", "shard", "position"))
    dealt = checkpoint(mixture(docs, weights, rest, block, shard_blocks, seed).select(F.col("doc_id").alias(doc), F.col("shard").alias(shard), F.col("position").alias(position)))
    out = join_checked(docs, dealt, F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)), "inner", 60)
    return out.repartition(shard).sortWithinPartitions(shard, position).drop(doc, shard, position)

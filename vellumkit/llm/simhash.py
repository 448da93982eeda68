"""SimHash near-duplicate groups, searched with BK-trees.

Every text gets a 256-bit SimHash of its lower-cased words, each with as many votes as the root of its count. Near
duplicates are documents whose hashes differ in at most ``radius`` bits; groups are the connected components.

The hashes are split into shards and each shard has its own BK-tree, in which a child hangs under the integer Hamming
distance to its parent, so that a search follows only edges in [d - radius, d + radius]. Shards overlap: a document
is in the shard of each of its ``anchors`` smallest hashes of three-word shingles, and is searched in those trees.
Copies share most shingles, so they meet in at least one shard (two texts with a shingle overlap of 0.5 miss each other
with a probability of about 2**-8). A tree goes to the tasks that search it by shuffle, not by broadcast, as trees grow
with the corpus. Within a shard every document is a query and no neighbour is cut off.

Documents of the same hash and anchors are joined to the least of them first, and only that one is searched. An anchor that
more than ``CELL`` others have is cut into parts, and each two parts are a shard of their own: every pair still meets, while no task
holds more than two parts.

Cost: one scan of the texts, a shuffle of 120 bytes a document and one of ``anchors`` x 48, and a few rounds over the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import checkpoint, join_checked, prepare

BITS, RADIUS, ANCHORS, CELL = 256, 40, 8, 1 << 14
LANES = BITS // 64
HASH = [f"h{j}" for j in range(LANES)]
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    x = h * (_C1 + np.uint64(2 * j))
    x ^= x >> np.uint64(29)
    x *= _C2
    return x ^ (x >> np.uint64(32))


def signature(text: str, anchors: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """(the hash as uint64 lanes, sorted anchor hashes). A text without words counts as one word: itself."""
    words = text.lower().split() or [text]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, (w.encode("utf-8", "surrogatepass") for w in words)) if not text.isascii() else map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    uniq, n = np.unique(h, return_counts=True)
    votes = np.repeat(uniq, np.sqrt(n).astype(np.int64))
    lanes = np.stack([_mixed(votes, j) for j in range(LANES)], axis=1)
    ones = np.zeros(BITS, np.int32)
    for a in range(0, len(lanes), 255):  # sums of 255 ones fit a byte
        ones += np.unpackbits(lanes[a : a + 255].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    s = h[:-2] * _C1 + h[1:-1] * _C2 + h[2:] if len(h) > 2 else np.array([np.bitwise_xor.reduce(h * _C3)])
    return np.packbits(2 * ones > len(votes)).view(np.uint64), np.unique(_mixed(s, 9))[:anchors]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hashes, anchor, n = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            if i is None or not t.is_valid:
                continue
            h, a = signature(t.as_py())
            ids.append(i), hashes.append(h), anchor.append(a), n.append(len(a))
        hashes = np.array(hashes, np.uint64).reshape(-1, LANES).view(np.int64)
        ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        anchors = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(anchor).view(np.int64) if anchor else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(hashes[:, j])) for j in range(LANES)), anchors], names=["doc_id", *HASH, "anchors"])


def _lower_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of each pair (a, b) in ``label``, in which each row holds the least row of its component."""
    while True:
        x, y = label[a], label[b]
        if not (differ := x != y).any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jumped := label[label] < label).any():
            label[jumped] = label[label[jumped]]


def _distance(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(h[a] ^ h[b]).sum(axis=1, dtype=np.int64)


def tree_components(shard: np.ndarray, h: np.ndarray, radius: int, chunk: int = 1 << 20) -> np.ndarray:
    """Build the BK-tree of each shard (rows sorted by ``shard``), search it for each row, and return for each row the
    least row of its component. All trees grow and are searched level by level, as arrays. A row looks for the neighbours
    before it, as the others find it: what is below a node comes after it, so a search leaves off at nodes after the row."""
    n = len(shard)
    label = np.arange(n)
    if not n:
        return label
    first = np.concatenate(([True], shard[1:] != shard[:-1]))
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    at, left = root.copy(), np.flatnonzero(~first)
    nodes, keys, childs = [np.flatnonzero(first)], [], []
    span = BITS + 1
    while left.size:
        d = _distance(h, left, at[left])
        same = d == 0
        _lower_labels(label, left[same], at[left[same]])
        left, d = left[~same], d[~same]
        key = at[left] * span + d
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        keys.append(key[new]), childs.append(left[new]), nodes.append(left[new])
        at[left] = left[new][np.cumsum(new) - 1]
        left = left[~new]
    node = np.concatenate(nodes)
    key, child = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, childs))
    order = np.argsort(key)
    key, child = key[order], child[order]
    todo = [(node[a : a + chunk // 16], root[node[a : a + chunk // 16]]) for a in range(0, len(node), chunk // 16)]
    while todo:
        q, v = todo.pop()
        if len(q) > chunk:
            todo += [(q[chunk:], v[chunk:])]
            q, v = q[:chunk], v[:chunk]
        d = _distance(h, q, v)
        _lower_labels(label, q[near := d <= radius], v[near])
        lo = np.searchsorted(key, v * span + np.maximum(d - radius, 0))
        many = np.searchsorted(key, v * span + np.minimum(d + radius, BITS), side="right") - lo
        if total := int(many.sum()):
            q = np.repeat(q, many)
            v = child[np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)]
            todo.append((q[before := v < q], v[before]))
    return label


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard may go on in the next batch."""

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        shard, ids, h = cols[0], cols[1], np.stack(cols[2:], axis=1).view(np.uint64)
        if len(shard):  # shards of one document have nothing to search
            more = np.concatenate((shard[1:] == shard[:-1], [False]))
            more[1:] |= more[:-1].copy()
            shard, ids, h = shard[more], ids[more], h[more]
        label = tree_components(shard, h, radius)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        least = least[label]
        keep = ids != least
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(least[keep])], names=["u", "v"])

    kept: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        new = np.flatnonzero(cols[0] != cols[0][-1])
        cut = new[-1] + 1 if len(new) else 0
        if cut:
            kept.append([c[:cut] for c in cols])
        elif kept and kept[-1][0][-1] != cols[0][0]:
            cut = -1
        if cut and kept:
            yield edges([np.concatenate(x) for x in zip(*kept)])
            kept = []
        kept.append([c[max(cut, 0) :] for c in cols])
    if kept:
        yield edges([np.concatenate(x) for x in zip(*kept)])


def connected_components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every end of an edge (u, v); group_id is the least id. Alternates large-star and small-star
    steps until no edge changes; each round is written to the checkpoint folder."""
    cur = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        said = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == mark or said[0] == 0:
            return cur.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
        mark = said
        least = F.min("v").over(Window.partitionBy("u"))
        both = cur.union(cur.select("v", "u")).withColumn("m", F.least(least, "u"))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", least).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        cur = checkpoint(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())


def _shards(found: DataFrame, cell: int) -> DataFrame:
    """(shard, doc_id, hash): a row for each anchor; for an anchor that more than ``cell`` rows have, one for each two parts that the row's is of."""
    rows = found.select(F.explode("anchors").alias("shard"), "doc_id", *HASH)
    hot = checkpoint(rows.groupBy("shard").count().where(F.col("count") > cell).select(F.col("shard").alias("hot"), F.ceil(F.col("count") / cell).cast("int").alias("parts")))
    if not hot.take(1):
        return rows
    marked = join_checked(rows, hot, F.col("shard") == F.col("hot"), "left", 100)
    part, other = F.pmod(F.xxhash64("doc_id"), "parts"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = marked.where("hot is not null").select("shard", "doc_id", *HASH, part.alias("part"), other)
    cells = cells.select(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("shard"), "doc_id", *HASH)
    return marked.where("hot is null").select("shard", "doc_id", *HASH).unionByName(cells)


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(doc_id, group_id) of the documents that have a near duplicate; group_id is the least doc_id of the group, so the
    row of the document that stays isn't listed.

    Rows that repeat a doc_id are one document, whose texts are all searched. A null doc_id or text has no duplicates. Texts without any
    word (empty ones too) are duplicates only if they are equal. Texts of any length are hashed whole. Other columns are not read.
    """
    prepare(docs.sparkSession)
    kinds = ", ".join(["doc_id bigint", *(f"{h} bigint" for h in HASH), "anchors array<bigint>"])
    sigs = checkpoint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signatures, kinds))
    same = checkpoint(sigs.groupBy(*HASH, "anchors").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    copies = same.where("n > 1").select(*(F.col(h).alias(f"c{h}") for h in HASH), F.col("anchors").alias("ca"), "least")
    on = [F.col(h) == F.col(f"c{h}") for h in HASH] + [F.col("anchors") == F.col("ca")]
    equal = join_checked(sigs, copies, on, "inner", 200).select(F.col("doc_id").alias("u"), F.col("least").alias("v")).where("u <> v")
    shards = _shards(same.withColumnRenamed("least", "doc_id"), cell)
    edges = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _search(it, radius), "u bigint, v bigint")
    edges = edges.unionByName(equal)
    return connected_components(edges)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each document (doc_id, group_id, kept): group_id is the least doc_id of its group of near duplicates,
    itself if it has none; ``kept`` marks the one that stays. Rows that repeat a doc_id give one row, as do null doc_ids."""
    groups = near_duplicate_groups(docs, radius)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return ids.join(groups, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.col("group_id").isNull().alias("kept"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group, the one with the least doc_id, as it is, with all its columns, whatever their names.
    Of rows that repeat a doc_id the one of the least text stays (of those, the least as JSON); rows with a null doc_id all stay."""
    gone = near_duplicate_groups(docs, radius).select(F.col("doc_id").alias("__gone"))
    again = checkpoint(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again"))
    kept = join_checked(docs, gone, docs["doc_id"] == gone["__gone"], "left_anti", 80)
    if not again.take(1):
        return kept
    once = join_checked(kept, again, kept["doc_id"] == again["__again"], "left_anti", 80)
    repeated = join_checked(kept, again, kept["doc_id"] == again["__again"], "left_semi", 80)
    nth = next(n for n in (f"__nth{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*docs.columns))))
    return once.unionByName(repeated.withColumn(nth, first).where(F.col(nth) == 1).drop(nth))

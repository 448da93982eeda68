import random

import corpus_pipeline as C
from vellumkit.llm import decontamination, mixing, sharding, simhash, toxicity

from .common import SCHEMA, edge_docs, edited, text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """Clean documents, copies, near copies, leaks, toxic ones, and nulls; truth by id."""
    rng = random.Random(0)
    items = [text(900 + k, 30) for k in range(5)]
    rows, truth = [], {}

    def add(t, kind, source="s0"):
        rows.append((len(rows), t, "en", source, len(t or "")))
        truth[len(rows) - 1] = kind

    boiler = text(700, 55)
    for k in range(160):
        t = text(k, 150)
        toxic = k % 8 == 0
        add(t + (" vilelyword foulterm" if toxic else f" {boiler}" if k % 5 == 1 else ""), "toxic" if toxic else "clean", f"src{k % 4}")
    for k in range(20):
        base = rows[8 * (k % 15) + 1][1]
        add(base if k % 2 else edited(base, k, 0.03), "copy", "src1")
    for k in range(10):
        add(f"{text(300 + k, 80)} {items[k % 5]} {text(400 + k, 80)}", "leak", "src2")
    add(None, "null", None)
    labels = [(i, 1, int(truth[i] == "toxic")) for i in range(0, 160) if rng.random() < 0.8]
    return rows, truth, labels, items


def write(spark, folder):
    rows, truth, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return truth


def test_planted_cases_and_brute_force(spark, tmp_path):
    truth = write(spark, str(tmp_path))
    kept = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(kept[name]) == len(set(kept[name]))
        assert docs.columns[:5] == COLUMNS and (k == len(C.STAGES) - 1 or docs.columns == COLUMNS)
    of = lambda name: {truth[i] for i in kept[name]}
    count = lambda name, kind: sum(truth[i] == kind for i in kept[name])
    assert "toxic" not in of("toxicity") and count("toxicity", "clean") == 140
    assert count("near_duplicates", "copy") == 0 and count("near_duplicates", "clean") == 140
    assert count("decontamination", "leak") == 0 and count("decontamination", "clean") == 140 and count("decontamination", "null") == 1
    assert set(kept["sharding"]) == set(kept["mixing"]) < set(kept["decontamination"])

    # run() against plain Python over the same rows
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    machine = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [i for i, r in rows.items() if r["text"] is None or machine.score(r["text"]) < toxicity.THRESHOLD]
    sig = {i: simhash.signature(rows[i]["text"])[0] for i in left if rows[i]["text"] is not None}
    label = {i: i for i in left}
    for a in sorted(sig):
        for b in sorted(sig):
            if a < b and simhash.np.bitwise_count(sig[a] ^ sig[b]).sum() <= simhash.RADIUS and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    left = [i for i in left if label[i] == i]
    items = [decontamination.normalise(t) for t in corpus()[3]]
    grams = {" ".join(w[k : k + 10]) for t in items for w in [t.split()] for k in range(len(w) - 9)}
    left = [i for i in left if rows[i]["text"] is None or not any(f" {g} " in decontamination.normalise(rows[i]["text"]) for g in grams)]
    got = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= set(left) and set(left) == set(kept["decontamination"])
    sizes = {s: sum(rows[i]["source"] == s for i in left) for s in {rows[i]["source"] for i in left}}
    quota = mixing.quotas(sizes)
    assert {s: sum(r["source"] == s for r in got) for s in sizes} == {s: min(sizes[s], quota.get(s, 0) * mixing.BLOCK) for s in sizes}
    assert {(r["doc_id"], r["shard"], r["position"]) for r in got} == {(r["doc_id"], r["shard"], r["position"]) for r in sharding.shard_assignment(spark.read.parquet(f"{tmp_path}/3")).collect()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_and_columns(spark, tmp_path):
    """Null ids, texts and sources, empty and very long texts, repeated rows, columns of the operators' names: through run() as through the stages."""
    docs = edge_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 1, 1), (6, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(9)), (None, text(4)), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [c for c in docs.columns if c not in ("shard", "position")] + ["shard", "position"]
    got = C.run(spark, str(tmp_path)).collect()
    assert got[0].__fields__ == want
    ids = sorted(str(r["doc_id"]) for r in got)
    assert ids == sorted(["None", "None", "1", "2", "3", "4", "5", "6", "7", "8"])  # one of the two rows 5; -9 holds an item
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] == 6} == {6: text(6, 60_000)}
    assert all(r["shard"] is not None and r["position"] is not None for r in got)


def test_a_stray_source_does_not_empty_the_pipeline(spark, tmp_path):
    rows = [(k, text(k, 40), "en", "src3" if k % 2 else "src4", 9) for k in range(200)] + [(900, text(900, 40), "en", None, 9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 201


def test_all_ten_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names

"""Evaluation metrics as aggregations. Results are tidy: slice columns, then values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

EPS = 1e-7


def accuracy(ok: Column) -> Column:
    """Mean of a boolean; null over no rows (A1-A3)."""
    return F.avg(ok.cast("double"))


def identical(pred: Column, gt: Column) -> Column:
    return T.norm(pred) == T.norm(gt)


def contained(pred: Column, gt: Column) -> Column:
    return F.contains(T.norm(pred), T.norm(gt))


def starts(pred: Column, gt: Column) -> Column:
    return F.startswith(T.norm(gt), T.norm(pred))


def keyword_match(pred: Column, gt: Column, keywords: list[str] | None = None) -> Column:
    """Equal after cleaning, or both hold a common keyword (A10)."""
    p, g = T.clean_string(pred), T.clean_string(gt)
    ok = p == g
    for k in keywords or []:
        ok = ok | (F.contains(p, F.lit(k)) & F.contains(g, F.lit(k)))
    return ok


def task_accuracy(df: DataFrame, task: str, pred: str, gt: str, keywords: list[str] | None = None) -> DataFrame:
    """(task, accuracy, n); tasks without a right answer have 0 (A10)."""
    return df.groupBy(task).agg(accuracy(keyword_match(F.col(pred), F.col(gt), keywords)).alias("accuracy"), F.count("*").alias("n"))


def sliced_accuracy(df: DataFrame, ok: Column, slices: dict[str, Column]) -> DataFrame:
    """One row: acc over all rows, and <name>_acc over those of each slice, null for an empty one."""
    return df.agg(accuracy(ok).alias("acc"), *[accuracy(F.when(c, ok)).alias(f"{n}_acc") for n, c in slices.items()])


def grouping_sets_accuracy(df: DataFrame, ok: Column, sets: list[list[str]]) -> DataFrame:
    """Accuracy over several groupings in one Expand + aggregate (A8, A16): their columns (null where not grouped), level (how many
    of them are grouped), acc, n."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    g = df.withColumn("__ok", ok.cast("double")).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return g.agg(F.avg("__ok").alias("acc"), F.count("*").alias("n"), *[(F.lit(1) - F.grouping(c)).cast("int").alias(f"by_{c}") for c in cols])


def macro_accuracy(df: DataFrame, ok: Column, source: str, task: str) -> DataFrame:
    """Mean over tasks of their accuracy, for each source and overall (source null); absent tasks don't count."""
    levels = grouping_sets_accuracy(df, ok, [[task], [source, task]])
    return levels.groupBy(f"by_{source}", source).agg(F.avg("acc").alias("macro_acc"), F.count("*").alias("n_tasks")).select(source, "macro_acc", "n_tasks", F.col(f"by_{source}").alias("is_source"))


def confusion(df: DataFrame, gt: str, pred: str, classes: int) -> DataFrame:
    """(gt, pred, n); rows whose truth is outside [0, classes) don't count."""
    return df.where((F.col(gt) >= 0) & (F.col(gt) < classes)).groupBy(F.col(gt).cast("int").alias("gt"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def class_counts(conf: DataFrame, classes: int) -> DataFrame:
    """(class, tp, row, col) for every class, from a confusion table, which has at most classes^2 rows."""
    sides = conf.select(F.explode(F.array(F.struct(F.col("gt").alias("class"), F.col("n").alias("row"), F.lit(0).cast("bigint").alias("col"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("row"), F.col("n").alias("col"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    every = conf.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"), F.lit(0).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("col"), F.lit(0).cast("bigint").alias("tp"))
    return sides.where((F.col("class") >= 0) & (F.col("class") < classes)).unionByName(every).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "row", "col")])


def confusion_scores(conf: DataFrame, classes: int) -> DataFrame:
    """One row: oa, class_acc, miou, kappa, fwiou (A12, A12b, A12e-A12g)."""
    c = class_counts(conf, classes).withColumn("total", F.sum("row").over(Window.partitionBy()))
    iou = lambda eps: F.try_divide(F.col("tp"), F.col("row") + F.col("col") - F.col("tp") + eps)
    s = c.agg(
        (F.sum("tp") / F.max("total")).alias("oa"), F.avg(F.col("tp") / (F.col("row") + EPS)).alias("class_acc"), F.avg(iou(EPS)).alias("miou"),
        F.sum(F.col("row") / F.col("total") * (F.col("col") / F.col("total"))).alias("pe"), F.sum(F.when(F.col("row") > 0, F.col("row") / F.col("total") * iou(0))).alias("fwiou"),
    )
    return s.select("oa", "class_acc", "miou", F.try_divide(F.col("oa") - F.col("pe"), 1 - F.col("pe")).alias("kappa"), "fwiou")


def binary_scores(conf: DataFrame) -> DataFrame:
    """One row: precision, recall, f1, iou of class 1 (A12c, A12e)."""
    tp, fp, fn = (F.sum(F.when((F.col("gt") == g) & (F.col("pred") == p), F.col("n")).otherwise(0)) for g, p in ((1, 1), (0, 1), (1, 0)))
    s = conf.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return s.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * r * p, r + p).alias("f1"), F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"))


def damage_f1(conf: DataFrame, classes: int) -> DataFrame:
    """(class, f1) without class 0 (A12d)."""
    return class_counts(conf, classes).where("class > 0").select("class", _f1().alias("f1"))


def _f1() -> Column:
    p, r = F.col("tp") / (F.col("col") + EPS), F.col("tp") / (F.col("row") + EPS)
    return 2 * p * r / (p + r + EPS)


def class_weighted_f1(conf: DataFrame, classes: int) -> DataFrame:
    """One row: F1 of the classes but 0, weighted by the inverse of their true counts; absent classes don't count (A12h)."""
    c = class_counts(conf, classes).where("class > 0 AND `row` > 0")
    return c.agg(F.try_divide(F.sum(_f1() / F.col("row")), F.sum(F.lit(1.0) / F.col("row"))).alias("class_weighted_f1"))


def area_weighted_f1(df: DataFrame, gt: str, pred: str, area: str, classes: list[str], skip: list[str] | None = None) -> DataFrame:
    """One row (f1, w_f1, inv_w_f1) of classified areas (A13): a prediction outside the classes adds its area to the truth's
    count only. The classes are few; three sums a class come from one pass."""
    rows = df.where(~F.col(gt).isin(skip)) if skip else df
    known = F.col(pred).isin(classes)
    g, p, a = F.col(gt), F.col(pred), F.col(area)
    zero = F.lit(0).cast("double")
    part = lambda c, tp, fp, fn, n: F.struct(c.alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), n.alias("n"))
    parts = F.array(part(g, F.when(p == g, a).otherwise(zero), zero, F.when(known & (p != g), a).otherwise(zero), a), part(p, zero, F.when(known & (p != g), a).otherwise(zero), zero, zero))
    stats = rows.withColumn(area, a.cast("double")).select(F.explode(parts).alias("s")).select("s.*").groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "n")])
    every = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    total = stats.agg(F.sum("n").alias("total"))
    c = every.join(stats, "class", "left").na.fill(0.0).crossJoin(total)  # all but one row a class
    pr, re = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    c = c.withColumn("f1", F.coalesce(F.try_divide(2 * pr * re, pr + re), zero)).withColumn("prev", F.try_divide("n", "total"))
    inv = F.when(F.col("prev") > 0, 1 / F.col("prev"))
    return c.agg(F.avg("f1").alias("f1"), F.sum(F.col("f1") * F.col("prev")).alias("w_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * inv), F.sum(inv)), zero).alias("inv_w_f1"))


def mae_mape(df: DataFrame, gt: Column, pred: Column, by: list[str]) -> DataFrame:
    """Mean absolute and relative errors over number pairs by position, up to the shorter list (A22, B16). Relative errors of a
    zero truth, and pairs with a null, don't count."""
    pairs = df.select(*by, F.explode(F.arrays_zip(gt.alias("g"), pred.alias("p"))).alias("z")).where("z.g is not null and z.p is not null")
    err = F.abs(F.col("z.p") - F.col("z.g"))
    return pairs.groupBy(*by).agg(F.avg(err).alias("mae"), F.avg(F.try_divide(err, F.abs("z.g"))).alias("mape"), F.count("*").alias("n"))


# --- n-gram metrics ------------------------------------------------------------------------------------------------


def tokens(x: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def ngrams(tok: Column, n: int) -> Column:
    return F.when(F.size(tok) >= n, F.transform(F.sequence(F.lit(0), F.size(tok) - n), lambda i: F.array_join(F.slice(tok, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _gram_counts(df: DataFrame, keys: list[str], tok: str, orders: int = 4) -> DataFrame:
    """(keys, n, gram, c). The grams of a row are counted as they are exploded, before the shuffle, by the partial aggregate."""
    tagged = lambda n: F.transform(ngrams(F.col(tok), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    both = F.flatten(F.array(*[tagged(n) for n in range(1, orders + 1)]))
    return df.select(*keys, F.explode(both).alias("x")).groupBy(*keys, F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(F.count("*").alias("c"))


def cider(df: DataFrame, key: str, pred: str, refs: str, sigma: float = 6.0) -> DataFrame:
    """(key, cider): the CIDEr-D score of each row, ten times the mean over n = 1..4 and the references; the corpus score
    is the mean x 100 (A7). Document frequencies count the rows whose references have the gram.

    The captions are moved once, to their key; their grams are counted where they are. Only the counts are moved to their gram, once:
    there the frequency and the answer's count are sums over neighbours, and what goes back is a part of each norm and product.
    """
    rows, grams = _sides(df, key, pred, refs, tokens)
    total = df.agg(F.count("*").alias("rows"))  # one row
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gram, own = Window.partitionBy("n", "g"), Window.partitionBy("n", "g", "__key")
    truth = F.col("ref") >= 0
    met = grams.repartition(tasks, "n", "g").withColumns({"p": F.max(F.when(~truth, F.col("c"))).over(own), "first": F.min(F.when(truth, F.col("ref"))).over(own)})
    met = met.withColumn("df", F.sum(F.when(F.col("ref") == F.col("first"), 1)).over(gram)).crossJoin(F.broadcast(total))
    idf = F.log("rows") - F.log(F.greatest(F.lit(1), F.coalesce("df", F.lit(0))))
    met = met.select("__key", "n", "ref", (F.col("c") * idf).alias("w"), (F.coalesce("p", F.lit(0)) * idf).alias("wp"))
    sums = met.groupBy("__key", "n", "ref").agg(F.sum(F.least("wp", "w") * F.col("w")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sums = sums.groupBy("__key").agg(F.collect_list(F.struct("n", "ref", "dot", "norm")).alias("e"))
    lengths = rows.select("__key", F.size("__p").alias("__lp"), F.transform("__r", F.size).alias("__lr"))
    norm_p = lambda n: F.aggregate(F.filter("e", lambda x: (x["ref"] < 0) & (x["n"] == n)), F.lit(0.0), lambda acc, x: acc + x["norm"])
    apart = lambda ref: F.col("__lp") - F.get("__lr", ref)
    near = lambda x: F.coalesce(F.try_divide(x["dot"], norm_p(x["n"]) * x["norm"]), F.lit(0.0)) * F.exp(-(apart(x["ref"]) ** 2) / (2 * sigma**2))
    s = F.aggregate(F.filter("e", lambda x: x["ref"] >= 0), F.lit(0.0), lambda acc, x: acc + near(x))
    scored = lengths.join(sums, "__key", "left").select(F.col("__key").alias(key), F.coalesce(10 * s / (4 * F.size("__lr")), F.lit(0.0)).alias("cider"))
    return scored


def _sides(df: DataFrame, key: str, pred: str, refs: str, tokens: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(__key, __p, __r: words of the answer and of each reference), moved once to its key; (__key, ref, n, g, c) of their grams, counted
    there: ref is -1 for the answer."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes of text with many grams aren't put in one task
    rows = df.select(F.col(key).alias("__key"), tokens(F.col(pred)).alias("__p"), F.coalesce(F.transform(refs, tokens), F.array().cast("array<array<string>>")).alias("__r")).repartition(tasks, "__key")
    sides = F.concat(F.array(F.struct(F.lit(-1).alias("ref"), F.col("__p").alias("tok"))), F.transform("__r", lambda t, i: F.struct(i.cast("int").alias("ref"), t.alias("tok"))))
    return rows, _gram_counts(rows.select("__key", F.explode(sides).alias("s")).select("__key", "s.ref", "s.tok"), ["__key", "ref"], "tok")


def bleu4(df: DataFrame, key: str, pred: str, refs: str, tokens: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row (bleu4): corpus BLEU with clipped counts and the closest reference length (A20); 0 if an order has no match. ``tokens``: how
    texts are cut, such as ``text.ptb_tokens``. Texts are moved once, to their key; grams aren't."""
    rows, grams = _sides(df, key, pred, refs, tokens)
    own, most = F.max(F.when(F.col("ref") < 0, F.col("c"))), F.max(F.when(F.col("ref") >= 0, F.col("c")))
    hits = grams.groupBy("__key", "n", "g").agg(own.alias("c"), most.alias("m")).where("c is not null").agg(
        *[F.sum(F.when(F.col("n") == n, F.least("c", F.coalesce("m", F.lit(0))))).alias(f"hit{n}") for n in (1, 2, 3, 4)],
        *[F.sum(F.when(F.col("n") == n, F.col("c"))).alias(f"all{n}") for n in (1, 2, 3, 4)],
    )
    best = F.array_min(F.transform("__r", lambda t: F.struct(F.abs(F.size(t) - F.size("__p")).alias("d"), F.size(t).alias("lr"))))
    lengths = rows.where(F.size("__r") > 0).agg(F.sum(F.size("__p")).alias("lp"), F.sum(best["lr"]).alias("lr"))
    ok = F.lit(True)
    for n in (1, 2, 3, 4):
        ok = ok & (F.coalesce(f"hit{n}", F.lit(0)) > 0)
    logs = sum(F.log(F.col(f"hit{n}") / F.col(f"all{n}")) for n in (1, 2, 3, 4)) / 4
    brevity = F.when(F.col("lp") >= F.col("lr"), F.lit(0.0)).otherwise(1 - F.col("lr") / F.col("lp"))
    return hits.crossJoin(lengths).select(F.when(ok, F.exp(logs + brevity)).otherwise(0.0).alias("bleu4"))


def perplexity(df: DataFrame, keys: list[str], nll: str) -> DataFrame:
    """exp of the mean token loss."""
    return df.groupBy(*keys).agg(F.exp(F.avg(nll)).alias("ppl"))


def diff_histogram(df: DataFrame, k1: Column, k2: Column) -> DataFrame:
    """(k1, k2, n, start, end): counts of the pairs of keys and their running places."""
    h = df.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, 0))
    return h.withColumns({"start": end - F.col("n"), "end": end})

"""Evaluation of scores against labels: exact curves, thresholds and summaries from counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import running, with_ranks


def curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score, highest first: score, tp, fp (rows at or above it), pos, neg (totals)."""
    counts = scored.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    counts = counts.withColumn("_f", F.col("_n") - F.col("_p"))
    totals = counts.agg(F.sum("_p").alias("pos"), F.sum("_f").alias("neg"))
    return running(counts, "score", {"tp": ("sum", "_p"), "fp": ("sum", "_f")}, descending=True).crossJoin(F.broadcast(totals)).drop("_n")


def roc_points(scored: DataFrame) -> DataFrame:
    return curve(scored).select("score", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def pr_points(scored: DataFrame) -> DataFrame:
    return curve(scored).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "pos").alias("recall"))


def areas(scored: DataFrame) -> DataFrame:
    """One row: auroc and average_precision, from one curve."""
    half = F.sum(F.col("_f") * (F.col("tp") - F.col("_p") / 2))
    steps = F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve(scored).agg(F.try_divide(half, F.first("pos") * F.first("neg")).alias("auroc"), F.try_divide(steps, F.first("pos")).alias("average_precision"))


def auroc(scored: DataFrame) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties counted half; null without both classes."""
    return areas(scored).select("auroc")


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: sum of recall steps times precision; null without positives."""
    return areas(scored).select("average_precision")


def confusion(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    yes, true = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(*(F.count_if(x).alias(n) for n, x in (("tn", ~yes & ~true), ("fp", yes & ~true), ("fn", ~yes & true), ("tp", yes & true))))


def ratios(c: DataFrame, undefined: float = 0.0) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc of a confusion row; `undefined` where a denominator is 0."""
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    zero = lambda x: F.coalesce(x, F.lit(undefined))
    return c.withColumns(
        {
            "accuracy": zero(F.try_divide(tp + tn, tp + tn + fp + fn)),
            "precision": zero(F.try_divide(tp, tp + fp)),
            "recall": zero(F.try_divide(tp, tp + fn)),
            "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
            "mcc": zero(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))),
        }
    )


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("score") - F.col("label")) ** 2).alias("brier_score"))


def best_threshold(scored: DataFrame, strategy: str = "f1", target_recall: float = 0.8, target_precision: float = 0.5, top_k: int = 200, fallback: bool = True) -> DataFrame:
    """One row: threshold. f1: highest F1, the least score on ties. target_recall: the highest score that meets it.
    target_precision: the least that meets it. top_k: the least score that at most top_k rows reach. Where there is none,
    0.5 (top_k: the highest score), or null without `fallback`."""
    c = curve(scored).withColumns({"p": F.col("tp") / (F.col("tp") + F.col("fp")), "r": F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0))})
    if strategy == "f1":
        f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
        out = c.agg(F.max(F.struct(F.round(f1, 12).alias("f"), (-F.col("score")).alias("s"))).alias("b")).select((-F.col("b.s")).alias("t"))
    elif strategy == "target_recall":
        out = c.agg(F.max(F.when(F.col("r") >= target_recall, F.col("score"))).alias("t"))
    elif strategy == "target_precision":
        out = c.agg(F.min(F.when(F.col("p") >= target_precision, F.col("score"))).alias("t"))
    elif strategy == "top_k":
        least = F.min(F.when(F.col("tp") + F.col("fp") <= top_k, F.col("score")))
        out = c.agg((F.coalesce(least, F.max("score")) if fallback else least).alias("t"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return out.select((F.coalesce("t", F.lit(0.5)) if fallback else F.col("t")).alias("threshold"))


def at_k(scored: DataFrame, ks: tuple[int, ...] = (50, 100, 200), key: str = "gene", undefined: float = 0.0) -> DataFrame:
    """k, hits, recall (`undefined` without positives) and precision of the k highest scores, ties by key."""
    first = scored.select("score", "label", key).orderBy(F.desc("score"), key).limit(max(ks))  # a top-k report
    placed = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col("label").alias("l")))).alias("rows"))
    total = scored.agg(F.sum("label").alias("_pos"))
    rows = placed.crossJoin(total).select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rows", "_pos")
    hits = F.aggregate(F.slice("rows", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, r: a + r["l"].cast("long"))
    return rows.select("k", hits.alias("hits"), F.coalesce(F.try_divide(hits, F.col("_pos")), F.lit(undefined)).alias("recall"), (hits / F.col("k")).alias("precision"))


def evaluate(scored: DataFrame, model: str, strategy: str = "f1", undefined: float = 0.0, **targets) -> DataFrame:
    """One row of model metrics, rounded to 4 places; ratios whose denominator is 0 are `undefined`."""
    t = best_threshold(scored, strategy, **targets)
    opt = ratios(confusion(scored.crossJoin(F.broadcast(t)), F.col("threshold")), undefined).select(
        "accuracy", "mcc", F.col("precision").alias("precision_opt"), F.col("recall").alias("recall_opt"), F.col("f1").alias("f1_opt")
    )
    half = ratios(confusion(scored), undefined).select(F.col("f1").alias("f1_at_05"))
    ks = at_k(scored, undefined=undefined).groupBy().pivot("k", [50, 100, 200]).agg(F.first("recall").alias("r"), F.first("precision").alias("p"))
    ks = ks.select(*(F.col(f"{k}_r").alias(f"recall_at_{k}") for k in (50, 100, 200)), *(F.col(f"{k}_p").alias(f"precision_at_{k}") for k in (50, 100)))
    out = auroc(scored).crossJoin(average_precision(scored).withColumnRenamed("average_precision", "auprc")).crossJoin(brier(scored))
    out = out.crossJoin(opt).crossJoin(half).crossJoin(t.withColumnRenamed("threshold", "optimal_threshold")).crossJoin(ks)  # one row each
    return out.select(F.lit(model).alias("model_name"), *(F.round(c, 4).alias(c) for c in out.columns))


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1 and support of each class, and their macro and weighted means."""
    c = confusion(scored, threshold)
    per = []
    for name, a, b, d in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn")):
        hit, wrong, missed = F.col(a), F.col(b), F.col(d)
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        per.append(c.select(F.lit(name).alias("class"), zero(F.try_divide(hit, hit + wrong)).alias("precision"), zero(F.try_divide(hit, hit + missed)).alias("recall"), zero(F.try_divide(2 * hit, 2 * hit + wrong + missed)).alias("f1"), (hit + missed).alias("support")))
    both = per[0].union(per[1])
    cols = ("precision", "recall", "f1")
    macro = both.agg(F.lit("macro avg").alias("class"), *(F.avg(x).alias(x) for x in cols), F.sum("support").alias("support"))
    weighted = both.agg(F.lit("weighted avg").alias("class"), *(F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in cols), F.sum("support").alias("support"))
    return both.union(macro).union(weighted)


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale a column to [0, 1]; the range gets 1e-12 so that a constant column becomes 0."""
    edge = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(edge)).withColumn(out, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12)).drop("_lo", "_hi")


def rank_genes(scored: DataFrame, annotation: DataFrame, threshold: float = 0.5, novel: float = 0.5) -> DataFrame:
    """The ranking: gene, predicted_prob, rank (least on ties, highest first), percentile, predicted_label, annotation, novel_candidate."""
    n = scored.agg(F.count("*").alias("_all"))
    down = with_ranks(scored, "score", descending=True).crossJoin(F.broadcast(n))
    # with ties averaged, the ascending average rank is n + 1 minus the descending one
    placed = down.select(
        "gene", F.col("score").alias("predicted_prob"), F.col("min_rank").cast("int").alias("rank"),
        F.round(100 * (F.col("_all") + 1 - F.col("average_rank")) / F.col("_all"), 2).alias("percentile"),
        (F.col("score") >= threshold).cast("int").alias("predicted_label"),
    )
    out = placed.join(annotation, "gene", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return out.withColumn("novel_candidate", (F.col("predicted_prob") >= novel) & (F.col("label") != 1)).orderBy(F.desc("predicted_prob"), "gene")


def ranking_metrics(ranking: DataFrame) -> DataFrame:
    """One row: median rank of known genes, hits, recall and precision at the top, novel candidates."""
    known = F.col("label") == 1
    total = F.count_if(known)
    hits = {k: F.count_if(known & (F.col("rank") <= k)) for k in (50, 100, 200, 500)}
    return ranking.agg(
        F.median(F.when(known, F.col("rank"))).alias("median_known_rank"),
        *(h.cast("int").alias(f"known_top{k}") for k, h in hits.items()),
        *(F.round(F.coalesce(F.try_divide(h, total), F.lit(0.0)), 4).alias(f"recall_at_{k}") for k, h in hits.items()),
        *(F.round(hits[k] / k, 4).alias(f"precision_at_{k}") for k in (50, 100)),
        F.count_if("novel_candidate").cast("int").alias("n_novel"),
        F.lit(True).alias("pu_framing"),
    )


def enrichment_curve(ranking: DataFrame) -> DataFrame:
    """Share of known genes found against share of genes looked at, in order of probability and gene."""
    keyed = ranking.select("gene", F.struct((-F.col("predicted_prob")).alias("s"), F.col("gene").alias("g")).alias("_k"), F.col("label").cast("long").alias("_l"), F.lit(1).cast("long").alias("_one"))
    total = ranking.agg(F.sum("label").alias("_pos"), F.count("*").alias("_all"))
    out = running(keyed, "_k", {"_hits": ("sum", "_l"), "position": ("sum", "_one")}).crossJoin(F.broadcast(total))
    return out.select("gene", "position", F.try_divide("_hits", "_pos").alias("found"), (F.col("position") / F.col("_all")).alias("share"))


def histogram(df: DataFrame, column: str, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts and density of a column in equal bins; the last one holds its upper end. Empty bins are listed."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(counts), "bin", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("bin", (low + F.col("bin") * width).alias("left"), n.alias("n"), F.coalesce(F.try_divide(n, F.col("_all") * width), F.lit(0.0)).alias("density"))

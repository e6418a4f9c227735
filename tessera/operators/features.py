"""Integration, pruning and scaling of feature tables, labels and splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_columns(df: DataFrame, key: str = "gene") -> list[str]:
    return [c for c, kind in df.dtypes if c != key and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]


def integrate(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two feature blocks by gene; a column that both have comes from the first."""
    return left.join(right.drop(*(set(left.columns) & set(right.columns) - {"gene"})), "gene", how)


def drop_constant(df: DataFrame, least: float = 1e-8) -> DataFrame:
    """Drop features whose sample variance is under `least`."""
    columns = feature_columns(df)
    spread = df.agg(*(F.var_samp(c).alias(c) for c in columns)).first()  # one row
    return df.drop(*(c for c in columns if spread[c] is None or spread[c] < least))


def correlated_pairs(df: DataFrame, least: float = 0.95) -> DataFrame:
    """Feature pairs with |Pearson r| >= least, strongest first: feature_a, feature_b, pearson_r (4 places).

    Each pair is of the rows that have both as finite numbers; r is missing where one of them doesn't vary there. Tasks multiply
    centred blocks of rows and give one row of sums a pair, so what is shuffled doesn't grow with the rows of a task.
    """
    columns = feature_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, pearson_r double")
    known = [F.when(F.abs(c) < float("inf"), F.col(c).cast("double")) for c in columns]
    middle = np.array([c or 0.0 for c in df.agg(*map(F.avg, known)).first()])  # one row
    i, j = np.triu_indices(len(columns), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, len(columns), len(columns)))
        for pdf in batches:
            x = pdf.to_numpy(float, na_value=np.nan)
            have = np.isfinite(x)
            x, have = np.where(have, x - middle, 0.0), have.astype(float)
            total += np.stack([have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x])
        n, one, square, cross = total
        yield pd.DataFrame({"_i": i, "_j": j, "n": n[i, j], "x": one[i, j], "y": one[j, i], "xx": square[i, j], "yy": square[j, i], "xy": cross[i, j]})

    sums = ("n", "x", "y", "xx", "yy", "xy")
    parts = df.select(*(v.alias(c) for v, c in zip(known, columns, strict=True))).mapInPandas(run, "_i long, _j long, " + ", ".join(f"{c} double" for c in sums))
    held = parts.groupBy("_i", "_j").agg(*(F.sum(c).alias(c) for c in sums))
    about = lambda one, square: F.col(square) - F.try_divide(F.col(one) ** 2, F.col("n"))
    spread = lambda one, square: F.when(about(one, square) > 1e-12 * F.col(square), about(one, square))
    r = F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n")), F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy")))
    names = F.array(*map(F.lit, columns))
    out = held.select(names[F.col("_i")].alias("feature_a"), names[F.col("_j")].alias("feature_b"), r.alias("r")).filter(F.abs("r") >= least)
    return out.select("feature_a", "feature_b", F.round("r", 4).alias("pearson_r")).orderBy(F.abs("pearson_r").desc(), "feature_a", "feature_b")


def drop_collinear(df: DataFrame, least: float = 0.95) -> DataFrame:
    """Greedily drop the later feature of each pair over the limit."""
    gone: set[str] = set()
    for r in correlated_pairs(df, least).collect():  # at most a pair per two features
        if not {r.feature_a, r.feature_b} & gone:
            gone.add(r.feature_b)
    return df.drop(*gone)


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: exact median and interquartile range of each column; a range of 0 counts as 1."""
    aggs = []
    for c in columns:
        spread = F.percentile(c, 0.75) - F.percentile(c, 0.25)
        aggs += [F.percentile(c, 0.5).alias(f"_c_{c}"), F.when(spread == 0, 1.0).otherwise(spread).alias(f"_s_{c}")]
    return df.agg(*aggs)


def standard_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a deviation of 0 counts as 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_c_{c}"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"_s_{c}")]
    return df.agg(*aggs)


def scale(df: DataFrame, parameters: DataFrame, columns: list[str]) -> DataFrame:
    """(x - centre) / spread by the given row of parameters, which may come from other rows (a training split)."""
    scaled = {c: (F.col(c) - F.col(f"_c_{c}")) / F.col(f"_s_{c}") for c in columns}
    return df.crossJoin(F.broadcast(parameters)).withColumns(scaled).select(*df.columns)


def label_genes(universe: DataFrame, labels: DataFrame) -> DataFrame:
    """gene, label (1 where the gene is in the list), pu_status."""
    known = labels.select("gene", F.lit(1).alias("_l")).distinct()
    out = universe.select("gene").join(known, "gene", "left").select("gene", F.coalesce("_l", F.lit(0)).alias("label"))
    return out.withColumn("pu_status", F.when(F.col("label") == 1, "positive").otherwise("unlabeled"))


def annotate(labels: DataFrame, de: DataFrame) -> DataFrame:
    """Labels with differential results; a gene without any gets log2fc 0, padj 1, direction ns and isn't significant."""
    cols = ["gene", "log2fc", "pvalue_adj", "neg_log10_padj", "cohens_d", "direction", "significant", "mean_tumor", "mean_normal"]
    out = labels.join(de.select(*cols), "gene", "left").withColumns(
        {
            "is_known": F.col("label") == 1,
            "log2fc": F.coalesce("log2fc", F.lit(0.0)),
            "pvalue_adj": F.coalesce("pvalue_adj", F.lit(1.0)),
            "direction": F.coalesce("direction", F.lit("ns")),
            "is_de_significant": F.coalesce("significant", F.lit(False)),
        }
    )
    return out.withColumn("is_known_and_de", F.col("is_known") & F.col("is_de_significant"))


def hash_order(key: str = "gene", seed: int = 42) -> Column:
    """A deterministic pseudo-random order that other engines can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _within_class(df: DataFrame, seed: int, label: str, key: str) -> DataFrame:
    """Add _k, the place in hash order inside the class, and _n, the size of the class."""
    # hash buckets keep a window from holding a whole class: places are counts of earlier buckets plus the place inside
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    counts = hashed.groupBy(label, "_b").agg(F.count("*").alias("_c"))  # at most 256 rows a class
    w = Window.partitionBy(label).orderBy("_b")
    starts = counts.select(
        label, "_b", (F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_s"), F.sum("_c").over(Window.partitionBy(label)).alias("_n")
    )
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    return hashed.join(F.broadcast(starts), [label, "_b"]).withColumn("_k", F.col("_s") + place).drop("_s", "_h", "_b")


def split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, label: str = "label", key: str = "gene") -> DataFrame:
    """Add is_test: of each class the first round(test_fraction * n) in hash order."""
    return _within_class(df, seed, label, key).withColumn("is_test", F.col("_k") <= F.round(test_fraction * F.col("_n"))).drop("_k", "_n")


def folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", key: str = "gene") -> DataFrame:
    """Add cv_fold 1..k, dealt in hash order inside each class."""
    return _within_class(df, seed, label, key).withColumn("cv_fold", ((F.col("_k") - 1) % k + 1).cast("int")).drop("_k", "_n")


def undersample(df: DataFrame, seed: int = 42, label: str = "label", key: str = "gene") -> DataFrame:
    """Cut every class to the size of the smallest, in hash order."""
    counted = _within_class(df, seed, label, key)
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return counted.crossJoin(F.broadcast(least)).filter(F.col("_k") <= F.col("_least")).select(*df.columns)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes * size) of each class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_all"), F.count("*").alias("_classes"))
    return sizes.crossJoin(total).select(label, "n", (F.col("_all") / (F.col("_classes") * F.col("n"))).alias("weight"))


def selected(importance: DataFrame, k: int = 21) -> list[str]:
    """The k features of best rank, best first."""
    return [r.feature for r in importance.filter(F.col("rank") <= k).orderBy("rank").select("feature").collect()]  # k names


def trim_unlabelled(train: DataFrame, scores: DataFrame, at: float = 0.9) -> DataFrame:
    """Training rows without the unlabelled genes that a first model scores `at` or more: positives not yet known, perhaps.
    A gene without a score stays."""
    noisy = scores.filter(F.col("score") >= at).select("gene", F.lit(0).alias("label"))
    return train.join(noisy, ["gene", "label"], "left_anti").select(*train.columns)

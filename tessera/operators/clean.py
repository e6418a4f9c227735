"""Cleaning, quality control and harmonisation of expression tables in long form: cohort, gene, sample, value.

A missing value is null, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Symbols that stand for a missing one.
INVALID_SYMBOLS = ["NAN", "", "NA", "NONE"]


def number(column: Column | str) -> Column:
    """A double, with null for what isn't a finite number."""
    c = F.col(column) if isinstance(column, str) else column
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def key(column: Column | str) -> Column:
    """A trimmed, upper-case key."""
    return F.upper(F.trim(column))


def valid_symbol(column: Column | str) -> Column:
    """False for blank, missing and purely numeric symbols."""
    k = key(column)
    return F.coalesce(~k.isin(INVALID_SYMBOLS) & ~k.rlike(r"^[0-9]+$"), F.lit(False))


def resolve(df: DataFrame, *names: str) -> str:
    """The column of the first of these names, in any case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    for name in names:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise ValueError(f"none of {names} is among {df.columns}")


def to_long(wide: DataFrame, gene_col: str, cohort: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Wide matrix (a row per gene, a column per sample) to long form with the row number; bad numbers become null."""
    samples = [c for c in wide.columns if c != gene_col and c not in drop]
    rows = wide.withColumn("_row", F.monotonically_increasing_id()).withColumns({c: number(F.col(f"`{c}`").cast("string")) for c in samples})
    long = rows.unpivot([gene_col, "_row"], samples, "sample", "value")
    return long.select(F.lit(cohort).alias("cohort"), F.col(gene_col).alias("gene"), "_row", "sample", "value")


def drop_blank(expr: DataFrame, gene: str = "gene") -> DataFrame:
    return expr.filter(F.trim(gene) != "")


def positive_only(value: Column | str) -> Column:
    """Values above zero; others are missing."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c > 0, c)


def log2p1(value: Column | str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.log2(c + 1)


def keep_highest_mean(expr: DataFrame, row: str = "_row") -> DataFrame:
    """Of several rows for a gene of a cohort the one of highest mean stays, then the first."""
    means = expr.groupBy("cohort", "gene", row).agg(F.avg("value").alias("_mean"))
    order = Window.partitionBy("cohort", "gene").orderBy(F.col("_mean").desc_nulls_last(), row)
    best = means.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("cohort", "gene", row)
    return expr.join(best, ["cohort", "gene", row], "left_semi")


def widths(expr: DataFrame) -> DataFrame:
    """Samples of each cohort, counted whether or not a gene has a value there."""
    return expr.groupBy("cohort").agg(F.countDistinct("sample").alias("n_samples"))


def expressed_genes(expr: DataFrame, min_value: float = 1.0, min_fraction: float = 0.10) -> DataFrame:
    """(cohort, gene) expressed above log2(min_value + 1) in at least min_fraction of all samples of the cohort."""
    level = F.log2(F.lit(min_value + 1.0))
    counts = expr.groupBy("cohort", "gene").agg(F.count_if(F.col("value") > level).alias("_n"))
    return counts.join(F.broadcast(widths(expr)), "cohort").filter(F.col("_n") / F.col("n_samples") >= min_fraction).select("cohort", "gene")


def iqr(value: Column | str) -> Column:
    return F.percentile(value, 0.75) - F.percentile(value, 0.25)


def variable_genes(expr: DataFrame, quantile: float = 0.10) -> DataFrame:
    """(cohort, gene) whose interquartile range is at least the given quantile of those of the cohort."""
    spread = expr.groupBy("cohort", "gene").agg(iqr("value").alias("_iqr"))
    least = spread.groupBy("cohort").agg(F.percentile("_iqr", quantile).alias("_least"))
    return spread.join(F.broadcast(least), "cohort").filter(F.col("_iqr") >= F.col("_least")).select("cohort", "gene")


def varying_genes(expr: DataFrame, quantile: float = 0.10) -> DataFrame:
    """Genes whose variance over all samples of both cohorts is above the given quantile of variances."""
    spread = expr.groupBy("gene").agg(F.var_samp("value").alias("_var"))
    least = spread.agg(F.percentile("_var", quantile).alias("_least"))
    return spread.crossJoin(F.broadcast(least)).filter(F.col("_var") > F.col("_least")).select("gene")


def keep(expr: DataFrame, genes: DataFrame) -> DataFrame:
    on = [c for c in ("cohort", "gene") if c in genes.columns]
    return expr.join(genes, on, "left_semi")


def match_samples(expr: DataFrame, metadata: DataFrame, sample_col: str, prefix: int = 12) -> DataFrame:
    """Samples that have metadata; if none has, both are compared by the first `prefix` characters of the sample."""
    meta = metadata.select(F.col(sample_col).alias("_id")).distinct()
    exact = expr.join(meta, expr["sample"] == meta["_id"], "left_semi")
    if exact.head(1):
        return exact
    short = expr.join(meta, F.substring("sample", 1, prefix) == meta["_id"], "left_semi")
    if not short.head(1):
        raise ValueError("no sample of the matrix has metadata")
    return short


def require_samples(expr: DataFrame, least: dict[str, int]) -> None:
    """Raise if a cohort has fewer samples than asked for."""
    found = {r["cohort"]: r["n_samples"] for r in widths(expr).collect()}  # one row per cohort
    short = {c: (found.get(c, 0), n) for c, n in least.items() if found.get(c, 0) < n}
    if short:
        raise ValueError(f"too few samples (found, needed): {short}")


def common_genes(expr: DataFrame) -> DataFrame:
    """Genes of every cohort with a valid symbol, as keys."""
    rows = expr.filter(valid_symbol("gene")).select("cohort", key("gene").alias("gene")).distinct()
    n = expr.select("cohort").distinct().agg(F.count("*").alias("_all"))
    return rows.groupBy("gene").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(n)).filter(F.col("_n") == F.col("_all")).select("gene")


def harmonise(expr: DataFrame) -> DataFrame:
    """Cohorts cut to their common genes, with keys as names."""
    keyed = expr.filter(valid_symbol("gene")).withColumn("gene", key("gene"))
    return keyed.join(common_genes(expr), "gene", "left_semi")


def lost_labels(labels: DataFrame, universe: DataFrame) -> DataFrame:
    return labels.join(universe, "gene", "left_anti")


def retention(labels: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """How many labels each gene set retains, and which are lost (sorted, joined by |)."""

    def one(name: str, genes: DataFrame) -> DataFrame:
        marked = labels.join(genes.select("gene", F.lit(True).alias("_in")).distinct(), "gene", "left")
        return marked.agg(
            F.lit(name).alias("stage"),
            F.count("*").alias("total_labels"),
            F.count("_in").alias("retained"),
            F.count_if(F.col("_in").isNull()).alias("lost"),
            F.round(F.try_divide(100.0 * F.count("_in"), F.count("*")), 2).alias("pct_retained"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("_in").isNull(), F.col("gene")))), "|").alias("lost_symbols"),
        )

    return reduce(DataFrame.unionByName, [one(n, g) for n, g in stages.items()])


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Genes of each cohort after each stage: dataset, stage, n_genes."""
    counted = [e.groupBy(F.col("cohort").alias("dataset")).agg(F.lit(name).alias("stage"), F.countDistinct("gene").alias("n_genes")) for name, e in stages.items()]
    return reduce(DataFrame.unionByName, counted)


def value_counts(expr: DataFrame) -> DataFrame:
    """Zeros, negatives, missing values and range of each cohort."""
    v = F.col("value")
    return expr.groupBy("cohort").agg(
        F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.count_if(v.isNull()).alias("n_missing"), F.min(v).alias("min_value"), F.max(v).alias("max_value")
    )


def sample_medians(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cohort", "sample").agg(F.median("value").alias("median"))

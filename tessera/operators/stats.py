"""Differential statistics and expression features of genes, from one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.functions.special import student_p
from tessera.operators.ordered import benjamini_hochberg, with_ranks

CASE, CONTROL = "tumor", "normal"
EPSILON = 1e-6


def _of(cohort: str) -> Column:
    return F.when(F.col("cohort") == cohort, F.col("value"))


def cohort_moments(expr: DataFrame, case: str = CASE, control: str = CONTROL) -> DataFrame:
    """Count, mean and sample variance of each gene in both cohorts, missing values left out."""
    aggs = []
    for name, cohort in (("1", case), ("2", control)):
        aggs += [F.count(_of(cohort)).alias(f"n{name}"), F.avg(_of(cohort)).alias(f"m{name}"), F.var_samp(_of(cohort)).alias(f"v{name}")]
    return expr.groupBy("gene").agg(*aggs)


def cohort_widths(expr: DataFrame, case: str = CASE, control: str = CONTROL) -> DataFrame:
    """One row: samples of each cohort as the matrix has them."""
    sample = lambda c: F.countDistinct(F.when(F.col("cohort") == c, F.col("sample")))
    return expr.agg(sample(case).alias("w1"), sample(control).alias("w2"))


def welch(moments: DataFrame) -> DataFrame:
    """Add t_stat and degrees of freedom of Welch's test; where it is undefined t is 0 and df null."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    enough = (F.col("n1") > 1) & (F.col("n2") > 1)
    return moments.withColumns({"t_stat": F.coalesce(F.when(enough, t), F.lit(0.0)), "df": F.when(enough, df)})


def student(moments: DataFrame) -> DataFrame:
    """Add t_stat and df of the equal-variance test."""
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), df)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    enough = (F.col("n1") > 1) & (F.col("n2") > 1)
    return moments.withColumns({"t_stat": F.coalesce(F.when(enough, t), F.lit(0.0)), "df": F.when(enough, df.cast("double"))})


def cohens_d(moments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add cohens_d; the pooled deviation is weighted by the widths of the matrices, 0 where it isn't positive."""
    pooled = F.sqrt(((F.col("w1") - 1) * F.col("v1") + (F.col("w2") - 1) * F.col("v2")) / (F.col("w1") + F.col("w2") - 2))
    return moments.crossJoin(F.broadcast(sizes)).withColumn("cohens_d", F.coalesce(F.when(pooled > 0, F.try_divide(F.col("m1") - F.col("m2"), pooled)), F.lit(0.0))).drop("w1", "w2")


def neg_log10(p: Column | str) -> Column:
    """-log10 of a p-value cut to [1e-300, 1]."""
    c = F.col(p) if isinstance(p, str) else p
    return -F.log10(F.greatest(F.least(c, F.lit(1.0)), F.lit(1e-300)))


def significance(fdr: float = 0.05, log2fc: float = 1.0, strict: bool = False) -> Column:
    p, fc = F.col("pvalue_adj"), F.abs("log2fc")
    return (p < fdr) & (fc > log2fc) if strict else (p <= fdr) & (fc >= log2fc)


def direction(significant: Column | str = "significant") -> Column:
    s = F.col(significant) if isinstance(significant, str) else significant
    return F.when(s & (F.col("log2fc") > 0), "up").when(s & (F.col("log2fc") < 0), "down").otherwise("ns")


def differential(expr: DataFrame, fdr: float = 0.05, log2fc: float = 1.0, test=welch) -> DataFrame:
    """Differential results of every gene with values in both cohorts.

    gene, mean_tumor, mean_normal, log2fc, t_stat, pvalue, pvalue_adj, neg_log10_padj, cohens_d, significant, direction.
    An undefined test has t 0 and p 1.
    """
    moments = cohort_moments(expr).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    tested = cohens_d(test(moments), cohort_widths(expr))
    tested = tested.withColumn("pvalue", F.coalesce(student_p("t_stat", "df"), F.lit(1.0))).withColumn("log2fc", F.col("m1") - F.col("m2"))
    out = benjamini_hochberg(cut(tested), "pvalue").withColumn("significant", significance(fdr, log2fc))
    return out.select(
        "gene", F.col("m1").alias("mean_tumor"), F.col("m2").alias("mean_normal"), "log2fc", "t_stat", "pvalue", "pvalue_adj",
        neg_log10("pvalue_adj").alias("neg_log10_padj"), "cohens_d", "significant", direction().alias("direction"),
    )


def sort_differential(de: DataFrame) -> DataFrame:
    return de.orderBy("pvalue_adj", F.abs("log2fc").desc(), "gene")


def expression_stats(expr: DataFrame) -> DataFrame:
    """mean, median, std, iqr, cv, skewness, kurtosis, pct_expressed of each gene and cohort, one pass.

    Skewness and kurtosis are the biased ones, 0 below 3 and 4 values; missing values count as not expressed.
    """
    v, n = F.col("value"), F.count("value")
    mean, std = F.avg(v), F.stddev_samp(v)
    width = expr.groupBy("cohort").agg(F.countDistinct("sample").alias("_width"))
    out = expr.groupBy("cohort", "gene").agg(
        mean.alias("mean"), F.median(v).alias("median"), std.alias("std"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr"),
        F.when(F.abs(mean) > EPSILON, F.try_divide(std, F.abs(mean))).otherwise(0.0).alias("cv"),
        F.when(n > 2, F.skewness(v)).otherwise(0.0).alias("skewness"), F.when(n > 3, F.kurtosis(v)).otherwise(0.0).alias("kurtosis"),
        F.count_if(v > 1).alias("_expressed"),
    )
    return out.join(F.broadcast(width), "cohort").withColumn("pct_expressed", F.col("_expressed") / F.col("_width")).drop("_expressed", "_width")


STATS = ["mean", "median", "std", "iqr", "cv", "skewness", "kurtosis", "pct_expressed"]
RANKED = ["tumor_mean", "abs_log2fc", "neg_log10_padj", "cohens_d", "tumor_iqr"]


def winsorise(df: DataFrame, columns: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Cut columns to their own quantiles."""
    q = df.agg(*(F.percentile(c, x).alias(f"_{i}_{c}") for c in columns for i, x in ((0, low), (1, high))))
    bounded = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_0_{c}")), F.col(f"_1_{c}"))) for c in columns}
    return df.crossJoin(F.broadcast(q)).withColumns(bounded).select(*df.columns)


def finite(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace missing and infinite values by the column's median, in one pass over all columns."""
    clean = df.withColumns({c: finite(c) for c in columns})
    medians = clean.agg(*(F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns))
    return clean.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).select(*df.columns)


def percentile_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank over the number of rows, missing values last."""
    n = df.agg(F.count("*").alias("_all"))
    return with_ranks(df, column).crossJoin(F.broadcast(n)).withColumn(out, F.col("average_rank") / F.col("_all")).drop("min_rank", "average_rank", "_all")


def expression_features(expr: DataFrame, de: DataFrame) -> DataFrame:
    """The 29 features of every gene: 8 statistics a cohort, 5 of the differential test, 3 ratios, 5 ranks; none missing.

    A gene without a test has 0 for what the test measures; its absolute change is missing, so it ranks last and gets the median.
    """
    wide = expression_stats(expr).groupBy("gene").agg(
        *(F.first(F.when(F.col("cohort") == cohort, F.col(s)), ignorenulls=True).alias(f"{name}_{s}") for name, cohort in (("tumor", CASE), ("normal", CONTROL)) for s in STATS)
    )
    measures = ("log2fc", "neg_log10_padj", "cohens_d", "t_stat")
    tests = de.select("gene", *(finite(c).alias(c) for c in measures), F.abs(F.coalesce(finite("log2fc"), F.lit(0.0))).alias("abs_log2fc"))
    df = wide.join(tests, "gene", "left").fillna(0.0, list(measures))
    ratios = {f"tumor_normal_{s}_ratio": F.col(f"tumor_{s}") / (F.col(f"normal_{s}") + EPSILON) for s in ("mean", "std", "iqr")}
    df = cut(winsorise(df.withColumns({k: finite(v) for k, v in ratios.items()}), list(ratios)))
    out = df
    for column in RANKED:  # each from the written table, so that none recomputes another
        out = out.join(percentile_rank(df.select("gene", column), column, f"{column}_rank").drop(column), "gene")
    df = cut(out)
    return impute_median(df, [c for c in df.columns if c != "gene"])

"""Tables that figures and reports draw: counts, joins and short lists, computed where the rows lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics

REGIONS = ("case only", "both", "control only")


def overlap_regions(case: DataFrame, control: DataFrame) -> DataFrame:
    """region, n: the genes of each region of a diagram of two overlapping sets. Empty regions are listed."""
    sides = case.select("gene", F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(control.select("gene", F.lit(0), F.lit(1)))
    held = sides.groupBy("gene").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    region = F.when(F.col("_b") == 0, REGIONS[0]).when(F.col("_a") == 0, REGIONS[2]).otherwise(REGIONS[1])
    counts = held.groupBy(region.alias("region")).agg(F.count("*").alias("n"))
    every = case.sparkSession.createDataFrame([(r,) for r in REGIONS], "region string")
    return every.join(F.broadcast(counts), "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))  # three rows


def ranked_differential(de: DataFrame, ranking: DataFrame) -> DataFrame:
    """Every gene of the differential test with its probability, rank and novelty, which are null where it has no rank."""
    return de.join(ranking.select("gene", "predicted_prob", "rank", "novel_candidate"), "gene", "left")


def change_histogram(de: DataFrame, column: str = "log2fc", bins: int = 100) -> DataFrame:
    """bin, left, n, density of all finite changes, in equal bins between the least and the greatest one."""
    known = de.filter(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf")))
    ends = known.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = (0.0, 1.0) if ends.low is None else (ends.low - 0.5, ends.high + 0.5) if ends.low == ends.high else (ends.low, ends.high)
    return metrics.histogram(known, column, bins, low, high)


def first_significant(de: DataFrame, k: int = 200) -> DataFrame:
    """The k significant genes of least adjusted p (to 6 places), then of greatest change, then by name."""
    return de.filter("significant").orderBy(F.round("pvalue_adj", 6), F.desc(F.round(F.abs("log2fc"), 9)), "gene").limit(k)


def class_balance(labels: DataFrame) -> DataFrame:
    """label, pu_status, n and share of the genes of each label."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("_all")))
    status = F.when(F.col("label") == 1, "positive").otherwise("unlabeled")
    return counts.crossJoin(total).select("label", status.alias("pu_status"), "n", (F.col("n") / F.col("_all")).alias("share"))


def degree_against_rank(ranking: DataFrame, degrees: DataFrame) -> DataFrame:
    """gene, rank, degree (0 without links) and category of each ranked gene."""
    kind = F.when(F.col("label") == 1, "known").when(F.col("novel_candidate"), "novel").otherwise("other")
    return ranking.join(degrees.select("gene", "degree"), "gene", "left").select("gene", "rank", F.coalesce("degree", F.lit(0)).alias("degree"), kind.alias("category"))


def top_pathways(results: DataFrame, k: int = 20, fdr: float = 0.05) -> DataFrame:
    """The k pathways of least adjusted p (to 9 places) below fdr, then by name."""
    return results.filter(F.col("padj") < fdr).orderBy(F.round("padj", 9), "pathway").limit(k)


def group_importance(importance: DataFrame) -> DataFrame:
    """feature_group, features, mean_importance."""
    return importance.groupBy("feature_group").agg(F.count("*").alias("features"), F.avg("mean_importance").alias("mean_importance"))


def run_summary(ranking: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ranked genes, known ones, novel candidates, mean probability, links and mean absolute weight."""
    genes = ranking.agg(
        F.count("*").alias("n_genes"), F.count_if(F.col("label") == 1).alias("n_known"), F.count_if("novel_candidate").alias("n_novel"), F.avg("predicted_prob").alias("mean_prob")
    )
    links = edges.agg(F.count("*").alias("n_edges"), F.avg("abs_weight").alias("mean_abs_weight"))
    return genes.crossJoin(F.broadcast(links))  # a row each

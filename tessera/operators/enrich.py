"""Over-representation of gene sets in a list, against the harmonised universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import hypergeometric_tail
from tessera.operators.ordered import benjamini_hochberg
from tessera.operators.stats import neg_log10


def enrich(hits: DataFrame, sets: DataFrame, universe: DataFrame, min_overlap: int = 3) -> DataFrame:
    """pathway, overlap ("a/b"), pvalue, padj, odds_ratio, combined_score, genes, overlap_genes, pathway_size, neg_log10_padj.

    sets: pathway, gene. One-sided hypergeometric test; adjusted over all sets that meet the list, before sets of fewer
    than min_overlap genes are left out.
    """
    inside = universe.select("gene").distinct()
    listed = hits.select("gene").distinct().join(inside, "gene", "left_semi")
    members = sets.select("pathway", "gene").distinct().join(inside, "gene", "left_semi")
    marked = members.join(listed.withColumn("_hit", F.lit(True)), "gene", "left")
    table = marked.groupBy("pathway").agg(
        F.count("_hit").alias("overlap_genes"), F.count("*").alias("pathway_size"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_hit"), F.col("gene").cast("string")))), ";").alias("genes")
    )
    sizes = listed.agg(F.count("*").alias("_drawn")).crossJoin(inside.agg(F.count("*").alias("_total")))  # one row
    tested = table.filter("overlap_genes > 0").crossJoin(F.broadcast(sizes)).withColumn("pvalue", hypergeometric_tail("overlap_genes", "_drawn", "pathway_size", "_total"))
    a, b, c = F.col("overlap_genes"), F.col("pathway_size") - F.col("overlap_genes"), F.col("_drawn") - F.col("overlap_genes")
    d = F.col("_total") - F.col("pathway_size") - c
    tested = tested.withColumn("odds_ratio", F.try_divide(a * d, b * c))
    out = benjamini_hochberg(tested, "pvalue", "padj").filter(F.col("overlap_genes") >= min_overlap)
    return out.select(
        "pathway", F.concat_ws("/", "overlap_genes", "pathway_size").alias("overlap"), "pvalue", "padj", "odds_ratio",
        (-F.ln(F.greatest("pvalue", F.lit(1e-300))) * F.col("odds_ratio")).alias("combined_score"), "genes", "overlap_genes", "pathway_size", neg_log10("padj").alias("neg_log10_padj"),
    )


def parse_overlap(overlap: Column | str) -> tuple[Column, Column, Column]:
    """Genes found, size and ratio from "a/b"."""
    parts = F.split(overlap, "/")
    a, b = parts[0].cast("int"), parts[1].cast("int")
    return a, b, F.try_divide(a, b)


def name_matches(column: Column | str, patterns: list[str]) -> Column:
    """Whether a name holds one of the patterns, in any case."""
    return reduce(lambda x, y: x | y, [F.contains(F.lower(column), F.lit(p.lower())) for p in patterns], F.lit(False))


def high_confidence(ranking: DataFrame, least: float = 0.80) -> dict[str, DataFrame]:
    """Gene lists of high probability: all, and by direction of the differential test."""
    top = ranking.filter(F.col("predicted_prob") >= least)
    return {"all": top.select("gene"), "up": top.filter("direction = 'up'").select("gene"), "down": top.filter("direction = 'down'").select("gene")}


def summarise(results: dict[str, DataFrame], fdr: float = 0.05) -> DataFrame:
    """subset, pathways_tested, significant, top_pathway, top_padj (6 places); a subset without pathways has a row of zeros."""
    rows = []
    for subset, r in results.items():
        best = F.min(F.struct("padj", "pathway"))
        rows.append(
            r.agg(F.lit(subset).alias("subset"), F.count("*").cast("int").alias("pathways_tested"), F.count_if(F.col("padj") <= fdr).cast("int").alias("significant"), best.alias("_b")).select(
                "subset", "pathways_tested", "significant", F.coalesce("_b.pathway", F.lit("")).alias("top_pathway"), F.round("_b.padj", 6).alias("top_padj")
            )
        )
    return reduce(DataFrame.union, rows)


def read_gmt(spark, path: str) -> DataFrame:
    """pathway, gene from a GMT file: name, description and genes, separated by tabs."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("pathway"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).alias("g")).select("pathway", F.upper(F.trim("g")).alias("gene")).filter("gene <> ''").distinct()

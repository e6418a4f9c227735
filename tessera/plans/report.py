"""Text report, summary table and a dependency-free HTML dashboard of a run. A section that fails is noted, not fatal."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.ordered import running


def summary_table(engine) -> DataFrame:
    """The ranking with network and expression columns, by rank; doubles rounded to 6 places."""
    net = ["degree", "weighted_degree", "betweenness_centrality", "closeness_centrality", "eigenvector_centrality", "clustering_coefficient", "component_size"]
    expr = ["tumor_mean", "tumor_std", "normal_mean", "normal_std", "tumor_pct_expressed", "normal_pct_expressed"]
    out = engine.table("gene_rankings").join(engine.table("network_features").select("gene", *net), "gene", "left").join(engine.table("expression_features").select("gene", *expr), "gene", "left")
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"}).orderBy("rank", "gene")


def text_of(df: DataFrame, rows: int = 20) -> str:
    """The first rows of a table as aligned text."""
    found = [df.columns, *([("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(rows).collect())]
    wide = [max(len(r[i]) for r in found) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in found)


def volcano(de: DataFrame) -> DataFrame:
    """gene, x, y, size, direction: -log10 adjusted p missing or not finite takes the 99.9 % quantile; sizes grow with the change."""
    top = de.agg(F.percentile(F.when(F.abs("neg_log10_padj") != float("inf"), F.col("neg_log10_padj")), 0.999).alias("_top"))
    y = F.when(F.col("neg_log10_padj").isNull() | F.isnan("neg_log10_padj") | (F.abs("neg_log10_padj") == float("inf")), F.col("_top")).otherwise(F.col("neg_log10_padj"))
    size = F.round(F.least(F.abs("log2fc"), F.lit(8.0)) * 2 + 4, 1)
    return de.crossJoin(F.broadcast(top)).select("gene", F.col("log2fc").alias("x"), y.alias("y"), size.alias("size"), "direction")


def thinned(df: DataFrame, by: str = "score", most: int = 2000) -> DataFrame:
    """At most so many rows of a curve, evenly over the descending order of `by` (distinct values), both ends kept."""
    n = df.count()
    if n <= most:
        return df
    step = lambda i: F.floor(i * F.lit(most - 1) / F.lit(n - 1))
    placed = running(df.withColumn("_one", F.lit(1)), by, {"_at": ("sum", "_one")}, descending=True)
    return placed.filter((F.col("_at") == 1) | (step(F.col("_at") - 1) > step(F.col("_at") - 2))).drop("_one", "_at")


def in_cells(points: DataFrame, across: int = 290, up: int = 170) -> DataFrame:
    """x, y, direction, n: the mean of all points of a direction in each cell of a plot, so that none is left out."""
    box = points.agg(F.min("x").alias("_x"), F.max("x").alias("_xx"), F.min("y").alias("_y"), F.max("y").alias("_yy"))
    cell = lambda v, lo, hi, n: F.floor(F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * n)
    placed = points.crossJoin(F.broadcast(box)).withColumns({"_i": cell("x", "_x", "_xx", across), "_j": cell("y", "_y", "_yy", up)})
    return placed.groupBy("_i", "_j", "direction").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).drop("_i", "_j")


def svg_scatter(points: list[tuple[float, float, str]], title: str, width: int = 640, height: int = 400) -> str:
    """A scatter plot; each point is x, y and a colour."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    at = lambda v, lo, hi, n: 30 + (v - lo) / ((hi - lo) or 1) * (n - 60)
    dots = "".join(f'<circle cx="{at(x, min(xs), max(xs), width):.1f}" cy="{height - at(y, min(ys), max(ys), height):.1f}" r="3" fill="{c}"/>' for x, y, c in points)
    return f'<svg viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title><rect width="100%" height="100%" fill="#fff"/>{dots}</svg>'


def svg_network(places: dict[str, tuple[float, float]], edges: list[tuple[str, str, bool]], title: str, size: int = 640) -> str:
    """Nodes at their places and edges (two nodes, positive or not) between them."""
    xs, ys = [p[0] for p in places.values()] or [0.0], [p[1] for p in places.values()] or [0.0]
    at = lambda v, all_v: 30 + (v - min(all_v)) / ((max(all_v) - min(all_v)) or 1) * (size - 60)
    drawn = {g: (at(x, xs), at(y, ys)) for g, (x, y) in places.items()}
    lines = "".join(
        f'<line x1="{drawn[a][0]:.1f}" y1="{drawn[a][1]:.1f}" x2="{drawn[b][0]:.1f}" y2="{drawn[b][1]:.1f}" stroke="{"#4a90d9" if up else "#e05a5a"}" stroke-opacity="0.4"/>' for a, b, up in edges
    )
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="#333"><title>{html.escape(str(g))}</title></circle>' for g, (x, y) in drawn.items())
    return f'<svg viewBox="0 0 {size} {size}" role="img"><title>{html.escape(title)}</title><rect width="100%" height="100%" fill="#fff"/>{lines}{dots}</svg>'


def svg_bars(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    top = max((v for _, v in rows), default=1) or 1
    bars = "".join(
        f'<text x="4" y="{20 * i + 14}" font-size="12">{html.escape(str(n))}</text><rect x="220" y="{20 * i + 3}" width="{max(v, 0) / top * (width - 240):.1f}" height="14" fill="#4878a8"/>' for i, (n, v) in enumerate(rows)
    )
    return f'<svg viewBox="0 0 {width} {20 * len(rows) + 10}" role="img"><title>{html.escape(title)}</title>{bars}</svg>'


def dashboard(tabs: dict[str, str]) -> str:
    """One HTML page with a section for each tab and links between them."""
    links = " ".join(f'<a href="#{i}">{html.escape(n)}</a>' for i, n in enumerate(tabs))
    body = "".join(f'<section id="{i}"><h2>{html.escape(n)}</h2>{content}</section>' for i, (n, content) in enumerate(tabs.items()))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Results</title></head><body><nav>{links}</nav>{body}</body></html>'


COLOURS = {"up": "#c44e52", "down": "#4c72b0", "ns": "#bbbbbb"}


def figures(engine) -> dict[str, str]:
    """Figures from plot tables of bounded size: curves thinned to 2000 points, all genes of the volcano in cells of two pixels."""
    drawn = volcano(engine.table("de_results")).filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull())
    v = in_cells(drawn).orderBy(F.col("direction") != "ns", "y", "x").collect()  # a row per cell; changed genes on top
    out = {"Differential": svg_scatter([(r.x, r.y, COLOURS[r.direction]) for r in v], "log2 fold change against -log10 adjusted p")}
    qc = engine.table("qc_summary").collect()
    out["Quality control"] = svg_bars([(f"{r.dataset} {r.stage}", r.n_genes) for r in qc], "Genes by stage")
    cv = engine.table("cv_results").select("model", "mean_auprc").collect()
    out["Models"] = svg_bars([(r.model, r.mean_auprc or 0) for r in cv], "Mean AUPRC by model")
    for name, table, x, y in (("ROC", "roc", "fpr", "tpr"), ("Precision and recall", "pr", "recall", "precision")):
        rows = thinned(engine.table(table)).orderBy(F.desc("score")).collect()
        out[name] = svg_scatter([(r[x] or 0, r[y] or 0, "#333") for r in rows], name)
    imp = engine.table("feature_importance").orderBy("rank").limit(20).collect()
    out["Importance"] = svg_bars([(r.feature, r.mean_importance) for r in imp], "Feature importance")
    top = engine.table("gene_rankings").orderBy("rank", "gene").limit(30).collect()
    out["Ranking"] = svg_bars([(r.gene, r.predicted_prob) for r in top], "Probability")
    edges = engine.table("annotated_edges")
    placed = graph.spring_layout(edges, engine.table("nodes"), engine.table("gene_rankings")).cache()
    places = {r.gene: (r.x, r.y) for r in placed.collect()}  # at most 150
    links = graph.induced(edges, placed).select("gene_a", "gene_b", F.col("weight") >= 0).collect()
    out["Network"] = svg_network(places, links, "Network of the 150 best-ranked genes")
    placed.unpersist()
    return out


def write(engine) -> dict[str, str]:
    """Write report and dashboard; returns what happened to each section."""
    done: dict[str, str] = {}
    tables = {
        "1. Quality control": "qc_summary", "2. Retention": "retention_report", "3. Network": "network_stats", "4. Models": "cv_results", "4b. Holdout": "model_metrics",
        "4c. Classes": "classification_report", "5. Importance": "feature_importance", "6. Ranking": "ranking_metrics", "7. Top genes": "gene_rankings",
    }
    parts = []
    for title, table in tables.items():
        try:
            parts.append(f"{title}\n{text_of(engine.table(table))}\n")
            done[title] = "ok"
        except Exception as e:  # a section that fails is reported in the result
            done[title] = f"failed: {e}"
    spark = engine.spark
    spark.createDataFrame([("\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(engine.path("report"))
    try:
        page = dashboard(figures(engine))
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(engine.path("dashboard"))
        done["dashboard"] = "ok"
    except Exception as e:
        done["dashboard"] = f"failed: {e}"
    return done

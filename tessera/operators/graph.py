"""Correlation networks as tables: nodes(gene) and edges(gene_a, gene_b, weight, abs_weight) with gene_a < gene_b."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.operators import packed

#: Rows and bytes of a block of the correlation matrix, at most: a block is shuffled once for each block. Rows of a tile of a task's product.
BLOCK, BLOCK_BYTES, TILE = 8192, 16_000_000, 2048
NETWORK_FEATURES = [
    "degree", "weighted_degree", "mean_edge_weight", "max_edge_weight", "min_edge_weight", "std_edge_weight", "avg_neighbor_degree", "betweenness_centrality",
    "closeness_centrality", "eigenvector_centrality", "clustering_coefficient", "component_size", "in_largest_component",
]


def vectors(expr: DataFrame) -> DataFrame:
    """Long form to gene, values (sorted by sample, null where a sample of the table is missing)."""
    samples = expr.select("sample").distinct()
    grid = expr.select("gene").distinct().crossJoin(F.broadcast(samples))  # the matrix itself, dense
    dense = grid.join(expr.select("gene", "sample", "value"), ["gene", "sample"], "left")
    return dense.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("v")).select("gene", F.col("v.value").alias("values"))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array([[np.nan if x is None else x for x in v] for v in values], float)


def _row_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks inside each row; missing values stay missing."""
    out = np.full_like(x, np.nan)
    for i, row in enumerate(x):
        good = np.isfinite(row)
        _, back, count = np.unique(row[good], return_inverse=True, return_counts=True)
        out[i, good] = (np.cumsum(count) - (count - 1) / 2)[back]
    return out


def zscores(x: np.ndarray) -> np.ndarray:
    """Rows less their mean over their sample deviation (0 counts as 1); a missing value makes its row missing."""
    sd = x.std(axis=1, ddof=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1, sd)


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of rows over the samples that both have."""
    ma, mb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    xa, xb = np.where(ma > 0, a, 0), np.where(mb > 0, b, 0)
    n = ma @ mb.T
    sa, sb, qa, qb = xa @ mb.T, ma @ xb.T, (xa**2) @ mb.T, ma @ (xb**2).T
    with np.errstate(invalid="ignore", divide="ignore"):
        return (xa @ xb.T - sa * sb / n) / np.sqrt((qa - sa**2 / n) * (qb - sb**2 / n))


def correlation_edges(genes: DataFrame, cutoff: float = 0.70, method: str = "pearson", nan_policy: str = "propagate", strict: bool = False, block: int | None = None) -> DataFrame:
    """gene_a, gene_b, correlation of all pairs with |r| >= cutoff (> if strict), by products of blocks of rows.

    genes: gene, values (arrays of one length). Rows are packed once into blocks (of up to BLOCK rows), and each pair of
    blocks is one task, which multiplies them tile by tile; only edges leave it. With nan_policy 'propagate' a gene with a missing value has no edges; with
    'pairwise' each pair uses the samples that both have.
    """
    n, wide = genes.agg(F.count("*"), F.coalesce(F.max(F.size("values")), F.lit(1))).first()
    block = block or max(128, min(BLOCK, max(TILE, BLOCK_BYTES // (8 * max(wide, 1))), -(-n // 8)))
    blocks = max(1, -(-n // block))
    kind, pairwise = genes.schema["gene"].dataType.simpleString(), nan_policy == "pairwise"

    def blocked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene")
        x = _matrix(pdf["values"])
        if method == "spearman":
            x = _row_ranks(x)
        x = x if pairwise else zscores(x)
        return pd.DataFrame({"blk": [int(pdf["blk"].iloc[0])], "genes": [pdf["gene"].tolist()], "x": [np.ascontiguousarray(x, float).tobytes()]})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        sides = {r.blk: (np.array(r.genes, object if kind == "string" else None), np.frombuffer(r.x).reshape(len(r.genes), -1)) for r in pdf.itertuples(index=False)}
        if low not in sides or high not in sides:
            return pd.DataFrame({"gene_a": [], "gene_b": [], "correlation": []})
        (left, a), (right, b) = sides[low], sides[high]
        found = []
        for top in range(0, len(a), TILE):
            for side in range(top if low == high else 0, len(b), TILE):
                x, y = a[top : top + TILE], b[side : side + TILE]
                r = _pairwise(x, y) if pairwise else x @ y.T / (a.shape[1] - 1)
                with np.errstate(invalid="ignore"):
                    hit = np.abs(r) > cutoff if strict else np.abs(r) >= cutoff
                if low == high and top == side:
                    hit &= np.triu(np.ones_like(hit), 1)
                i, j = np.nonzero(hit)
                found.append((i + top, j + side, r[i, j]))
        i, j, r = (np.concatenate(x) for x in zip(*found, strict=True))
        x, y = left[i], right[j]
        swap = np.array(x > y, bool)
        return pd.DataFrame({"gene_a": np.where(swap, y, x), "gene_b": np.where(swap, x, y), "correlation": r})

    own = genes.select("gene", "values", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("blk"))
    rows = own.groupBy("blk").applyInPandas(blocked, f"blk int, genes array<{kind}>, x binary")
    dealt = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("blk", "genes", "x", F.least("blk", "_o").alias("_low"), F.greatest("blk", "_o").alias("_high"))
    return dealt.groupBy("_low", "_high").applyInPandas(run, f"gene_a {kind}, gene_b {kind}, correlation double")


def weighted(edges: DataFrame) -> DataFrame:
    return edges.select("gene_a", "gene_b", F.col("correlation").alias("weight"), F.abs("correlation").alias("abs_weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("gene_a").alias("gene")).union(edges.select("gene_b")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("gene_a").alias("gene"), F.col("gene_b").alias("other"), "abs_weight").union(edges.select("gene_b", "gene_a", "abs_weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree, weighted degree and statistics of incident weights of nodes with edges, in one aggregation."""
    w = F.col("abs_weight")
    return symmetric(edges).groupBy("gene").agg(
        F.count("*").alias("degree"), F.sum(w).alias("weighted_degree"), F.avg(w).alias("mean_edge_weight"), F.max(w).alias("max_edge_weight"), F.min(w).alias("min_edge_weight"), F.stddev_pop(w).alias("std_edge_weight")
    )


def neighbour_degree(edges: DataFrame) -> DataFrame:
    d = symmetric(edges).groupBy("gene").agg(F.count("*").alias("_d"))
    return symmetric(edges).join(d.withColumnRenamed("gene", "other"), "other").groupBy("gene").agg(F.avg("_d").alias("avg_neighbor_degree"))


def _clustering(graph: packed.Packed, degree: np.ndarray, use_weights: bool) -> DataFrame:
    top = None
    if use_weights and graph.links:
        top = max(r.top for r in graph.rows(lambda first, ptr, cols, w: pd.DataFrame({"top": [w.max(initial=0.0)]}), "top double").collect())  # a number for each block
    found = packed.triangles(graph, degree, top)
    d = graph.index.join(graph.named({"_d": degree}), "gene").filter("_d > 0")
    c = F.coalesce(F.try_divide(2 * F.col("t"), F.col("_d") * (F.col("_d") - 1)), F.lit(0.0))
    return d.join(found, "node", "left").select("gene", c.alias("clustering_coefficient"))


def clustering(edges: DataFrame, use_weights: bool = True) -> DataFrame:
    """Clustering coefficient of nodes with edges: weights over their maximum, geometric mean of each triangle."""
    edges = cut(edges)
    graph = packed.pack(edges, endpoints(edges))
    return _clustering(graph, graph.degree(), use_weights)


def _components(graph: packed.Packed) -> DataFrame:
    found = cut(graph.named({"_label": packed.labels(graph)}))
    each = found.groupBy("_label").agg(F.min("gene").alias("component"), F.count("*").alias("component_size"))
    largest = each.agg(F.min(F.struct((-F.col("component_size")).alias("s"), "component")).alias("_l")).select(F.col("_l.component").alias("_largest"))
    out = found.join(each, "_label").crossJoin(F.broadcast(largest))  # one row
    return out.select("gene", "component", "component_size", (F.col("component") == F.col("_largest")).cast("int").alias("in_largest_component"))


def component_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """gene, component, component_size, in_largest_component; the largest with the least label wins ties."""
    return _components(packed.pack(edges, nodes))


def _distances(graph: packed.Packed) -> DataFrame:
    n = graph.n
    if n == 0:
        return graph.index.select("gene", F.lit(0.0).alias("betweenness_centrality"), F.lit(0.0).alias("closeness_centrality"))
    share, reach, far = packed.distances(graph, np.arange(n))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    near = np.divide((reach - 1.0) ** 2, far * float(max(n - 1, 1)), out=np.zeros(n), where=far > 0)
    return graph.named({"betweenness_centrality": share * scale, "closeness_centrality": near})


def distance_measures(edges: DataFrame, nodes: DataFrame, local_links: int = packed.LOCAL_LINKS) -> DataFrame:
    """gene, betweenness_centrality, closeness_centrality of all nodes, without weights.

    Betweenness is normalised. Both are exact at any size: every node is a source. Closeness is scaled by the size of the
    component. Many sources are searched side by side, one bit each (one number each
    for betweenness); a graph of up to local_links directed links is sent to the tasks, of a larger one they read blocks.
    """
    return _distances(packed.pack(edges, nodes, local_links))


def _eigenvector(graph: packed.Packed, degree: np.ndarray, iterations: int, tolerance: float) -> DataFrame:
    if graph.n == 0:
        return graph.index.select("gene", F.lit(0.0).alias("eigenvector_centrality"))
    x = packed.eigenvector(graph, iterations, tolerance)
    return graph.named({"eigenvector_centrality": degree / max(degree.max(), 1) if x is None else x})


def eigenvector(edges: DataFrame, nodes: DataFrame, iterations: int = 1000, tolerance: float = 1e-6, local_links: int = packed.LOCAL_LINKS) -> DataFrame:
    """gene, eigenvector_centrality on |weight|: x + Ax, normalised, until the change is under n * tolerance.

    Without convergence the degree over the greatest degree. The vector is on the driver; the products are taken there
    up to local_links directed links, and beyond by the tasks, each for its blocks.
    """
    graph = packed.pack(edges, nodes, local_links)
    return _eigenvector(graph, graph.degree(), iterations, tolerance)


def network_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The 13 network features of every node of the universe; isolated ones have zeros. Edges are computed and packed once."""
    graph = packed.pack(edges, nodes)
    degree = graph.degree()
    return _features(graph, degree, _distances(graph), _eigenvector(graph, degree, 1000, 1e-6))


def local_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The network features but betweenness, closeness and the eigenvector, which aren't computed."""
    graph = packed.pack(edges, nodes)
    return _features(graph, graph.degree())


def _features(graph: packed.Packed, degree: np.ndarray, *more: DataFrame) -> DataFrame:
    own = graph.index.join(packed.incident(graph, degree), "node").select("gene", "degree", "weighted_degree", "avg_neighbor_degree", "mean_edge_weight", "max_edge_weight", "min_edge_weight", "std_edge_weight")
    out = graph.index.select("gene")
    for part in (own, *more, _clustering(graph, degree, True), _components(graph).drop("component")):
        out = out.join(part, "gene", "left")
    return out.select("gene", *(c for c in NETWORK_FEATURES if c in out.columns)).fillna(0)


def induced(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges between genes of a set."""
    keep = genes.select("gene").distinct()
    return edges.join(keep.withColumnRenamed("gene", "gene_a"), "gene_a", "left_semi").join(keep.withColumnRenamed("gene", "gene_b"), "gene_b", "left_semi").select(*edges.columns)


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """metric, value: nodes, edges, density, components, largest component, mean unweighted clustering, degrees, assortativity."""
    graph = packed.pack(edges, nodes)
    degree, n = graph.degree(), graph.n
    m = int(degree.sum()) // 2
    sizes = np.unique(packed.labels(graph), return_counts=True)[1]
    wedges = F.col("_d") * (F.col("_d") - 1)
    local = packed.triangles(graph, degree).join(graph.index.join(graph.named({"_d": degree}), "gene"), "node").agg(F.sum(2 * F.col("t") / wedges).alias("s")).first().s
    r = packed.assortativity(graph, degree)
    found = {
        "n_nodes": n, "n_edges": m, "density": round(2 * m / (n * (n - 1)), 8) if n > 1 else 0, "avg_degree": round(2 * m / max(n, 1), 6),
        "n_connected_components": len(sizes), "largest_component_size": sizes.max() if n else None, "avg_clustering_coeff": round((local or 0) / max(n, 1), 6),
        "max_degree": degree.max(initial=0), "degree_assortativity": r if r is None else round(r, 6),
    }
    return nodes.sparkSession.createDataFrame([(k, v if v is None else float(v)) for k, v in found.items()], "metric string, value double")


def hubs(edges: DataFrame, k: int = 20) -> DataFrame:
    return degrees(edges).select("gene", "degree", "weighted_degree").orderBy(F.desc("degree"), "gene").limit(k)


def node_color(known: str = "is_known", novel: str = "novel_candidate", significant: str = "is_de_significant"):
    """Category of a node, the first that holds."""
    return F.when(F.col(known), "known").when(F.col(novel), "novel").when(F.col(significant), "de").otherwise("none")


def annotated_nodes(nodes: DataFrame, ranking: DataFrame, features: DataFrame | None = None) -> DataFrame:
    out = nodes.select("gene").join(ranking, "gene", "left")
    if features is not None:
        out = out.join(features, "gene", "left")
    probability = F.coalesce("predicted_prob", F.lit(0.0))
    return out.withColumns({"node_color": node_color(), "node_size": 5 + probability * 45})


def annotated_edges(edges: DataFrame, ranking: DataFrame, candidate: float = 0.5) -> DataFrame:
    """Edges with sign, ranks and probabilities of both ends, and whether both are candidates."""
    a = ranking.select(F.col("gene").alias("gene_a"), F.col("rank").alias("gene_a_rank"), F.col("predicted_prob").alias("gene_a_prob"))
    b = ranking.select(F.col("gene").alias("gene_b"), F.col("rank").alias("gene_b_rank"), F.col("predicted_prob").alias("gene_b_prob"))
    both = (F.coalesce("gene_a_prob", F.lit(0.0)) >= candidate) & (F.coalesce("gene_b_prob", F.lit(0.0)) >= candidate)
    kind = F.when(F.col("weight") >= 0, "positive").otherwise("negative")
    out = edges.withColumn("edge_type", kind).join(a, "gene_a", "left").join(b, "gene_b", "left")
    return out.select("gene_a", "gene_b", "weight", "abs_weight", "edge_type", "gene_a_rank", "gene_b_rank", "gene_a_prob", "gene_b_prob", both.alias("both_candidates"))


def differential_network(case: DataFrame, control: DataFrame) -> DataFrame:
    """Edges of either cohort with both correlations (0 where under the cutoff) and their difference."""
    a = case.select("gene_a", "gene_b", F.col("correlation").alias("r_case"))
    b = control.select("gene_a", "gene_b", F.col("correlation").alias("r_control"))
    out = a.join(b, ["gene_a", "gene_b"], "full_outer").fillna(0.0, ["r_case", "r_control"])
    return out.withColumn("difference", F.col("r_case") - F.col("r_control"))


def spring_layout(edges: DataFrame, nodes: DataFrame, ranking: DataFrame, k: float = 1.8, iterations: int = 80, seed: int = 42, most: int = 150) -> DataFrame:
    """gene, x, y of the `most` nodes of least rank, ties by gene, by force-directed placement in one task (a plot holds few nodes).

    Nodes without a rank are left out.
    """
    ranked = ranking.filter(F.col("rank").isNotNull()).select("gene", "rank")
    chosen = nodes.select("gene").join(ranked, "gene").orderBy("rank", "gene").limit(most).select("gene")
    kind = nodes.schema["gene"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        genes = sorted(pdf["gene_a"][pdf["abs_weight"].isna()])
        at, pairs = {g: i for i, g in enumerate(genes)}, pdf[pdf["abs_weight"].notna()]
        w = np.zeros((len(genes), len(genes)))
        i, j = pairs["gene_a"].map(at).to_numpy(int), pairs["gene_b"].map(at).to_numpy(int)
        w[i, j] = w[j, i] = pairs["abs_weight"]
        place = np.random.default_rng(seed).random((len(genes), 2))
        heat = 0.1 * max(np.ptp(place, axis=0).max() if len(genes) else 0, 1e-9)
        for step in range(iterations):
            gap = place[:, None] - place[None]
            far = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
            move = (gap * (k * k / far**2 - w * far / k)[..., None]).sum(axis=1)
            length = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 0.01)
            place = place + move / length * np.minimum(length, heat * (1 - step / (iterations + 1)))
        return pd.DataFrame({"gene": pd.Series(genes, dtype=object), "x": place[:, 0], "y": place[:, 1]})

    none = F.lit(None)
    rows = induced(edges, chosen).select("gene_a", "gene_b", "abs_weight").union(chosen.select("gene", none.cast(kind), none.cast("double")))
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"gene {kind}, x double, y double")

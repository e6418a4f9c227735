from collections import deque

import numpy as np
import pytest

from tessera.operators import graph, packed


def random_graph(seed, n=60, p=0.08):
    rng = np.random.default_rng(seed)
    w = np.triu((rng.random((n, n)) < p) * rng.uniform(0.3, 1, (n, n)), 1)
    w[-3:] = w[:, -3:] = 0  # isolated nodes
    w[3, 9:40] = 0.5  # a hub
    return w + w.T


def brute(w):
    """Brandes' dependencies, nodes reached, distances, triangles and components of a matrix of weights, node by node."""
    n = len(w)
    share, reach, far, root = np.zeros(n), np.zeros(n, int), np.zeros(n, int), np.arange(n)
    for s in range(n):
        dist, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in np.flatnonzero(w[u]).tolist():
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0.0
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        back = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in np.flatnonzero(w[v]).tolist():
                if dist[u] == dist[v] - 1:
                    back[u] += paths[u] / paths[v] * (1 + back[v])
        for v in order:
            share[v] += back[v] if v != s else 0
        reach[s], far[s], root[s] = len(dist), sum(dist.values()), min(dist)
    a = (w > 0).astype(int)
    return share, reach, far, root, np.diag(np.cbrt(w) @ np.cbrt(w) @ np.cbrt(w)) / 2, np.diag(a @ a @ a) // 2


@pytest.mark.parametrize("local_links", [10**6, 0])
def test_like_brute_force(spark, monkeypatch, local_links):
    monkeypatch.setattr(packed, "STATE", 60 * 8 * 16)  # several batches
    w = random_graph(4)
    i, j = np.nonzero(np.triu(w))
    edges = spark.createDataFrame([(f"g{a:02}", f"g{b:02}", float(w[a, b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)], "gene_a string, gene_b string, abs_weight double")
    nodes = spark.createDataFrame([(f"g{a:02}",) for a in range(len(w))], "gene string")
    g = packed.pack(edges, nodes, local_links, side=20)
    assert g.blocks.count() == 3
    node = {r.node: int(r.gene[1:]) for r in g.index.collect()}
    at = np.array([node[k] for k in range(g.n)])
    share, reach, far, root, weighted, plain = (x[at] for x in brute(w))
    degree = g.degree()
    assert degree.tolist() == (w > 0).sum(axis=0)[at].tolist()
    got = packed.distances(g, np.arange(g.n))
    assert got[0] == pytest.approx(share) and got[1].tolist() == reach.tolist() and got[2].tolist() == far.tolist()
    label = packed.labels(g)
    assert (label[:, None] == label[None]).tolist() == (root[:, None] == root[None]).tolist()
    for top, want in ((None, plain), (1.0, weighted), (0.5, weighted / 0.5)):
        found = {r.node: r.t for r in packed.triangles(g, degree, top, pair_links=40).collect()}
        assert found == pytest.approx({k: float(x) for k, x in enumerate(want) if x})
    x = packed.eigenvector(g, 1000, 1e-9)
    values, vectors = np.linalg.eigh(w)
    assert np.abs(x) == pytest.approx(np.abs(vectors[:, -1])[at], abs=1e-4)
    inside = {r.node: r for r in packed.incident(g, degree).collect()}
    assert inside.keys() == {k for k in range(g.n) if degree[k]}
    for k, r in inside.items():
        own = w[at[k]][w[at[k]] > 0]
        assert (r.weighted_degree, r.max_edge_weight, r.min_edge_weight, r.std_edge_weight) == pytest.approx((own.sum(), own.max(), own.min(), own.std()))
        assert r.avg_neighbor_degree == pytest.approx((w > 0).sum(axis=0)[w[at[k]] > 0].mean())
    d = (w > 0).sum(axis=0)
    a, b = np.nonzero(w)
    assert packed.assortativity(g, degree) == pytest.approx(np.corrcoef(d[a], d[b])[0, 1])


def test_without_edges(spark):
    edges = spark.createDataFrame([], "gene_a string, gene_b string, weight double, abs_weight double")
    nodes = spark.createDataFrame([("a",), ("b",)], "gene string")
    rows = graph.network_features(edges, nodes).collect()
    assert len(rows) == 2 and all(r.degree == 0 and r.component_size == 1 and r.betweenness_centrality == 0 for r in rows)
    stats = {r.metric: r.value for r in graph.statistics(edges, nodes).collect()}
    assert (stats["n_edges"], stats["n_connected_components"], stats["degree_assortativity"], stats["avg_clustering_coeff"]) == (0, 2, None, 0)
    assert graph.network_features(edges, nodes.limit(0)).count() == 0 and graph.clustering(edges).count() == 0

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.special import log_gamma, student_two_sided
from tessera.operators import clean, enrich, features, graph, metrics, ml, stats
from tessera.operators.ordered import benjamini_hochberg, running, with_ranks


def test_log_gamma_and_student():
    assert np.allclose(log_gamma(np.array([0.5, 1, 4.5, 100])), [math.lgamma(x) for x in (0.5, 1, 4.5, 100)])
    p = student_two_sided(np.array([2.228139, 1.96, 0.0, 60.0, 1e3]), np.array([10, 1e6, 5, 300, 500]))
    assert np.allclose(p[:3], [0.05, 0.05, 1.0], atol=1e-5)
    assert 0 < p[3] < 1e-160 and 0 <= p[4] < 1e-300


def test_benjamini_hochberg(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", None), ("f", 0.5), ("g", 0.03), ("h", 0.0)]
    got = {r.gene: r.q for r in benjamini_hochberg(spark.createDataFrame(rows, "gene string, p double"), "p", "q").collect()}
    known = sorted((p, g) for g, p in rows if p is not None)
    low, want = 1.0, {}
    for i in range(len(known) - 1, -1, -1):
        low = min(low, known[i][0] * len(known) / (i + 1))
        want[known[i][1]] = low
    assert got.pop("e") is None and got == pytest.approx(want)


@pytest.mark.parametrize("parts", [1, 5])
def test_running_and_ranks_do_not_depend_on_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(float(x % 7), x) for x in range(50)] + [(None, 99)], "v double, n long")
        distinct = df.groupBy("v").count().filter("v IS NOT NULL")
        out = [r["total"] for r in running(distinct, "v", {"total": ("sum", "count")}).orderBy("v").collect()]
        assert out == np.cumsum([8] + [7] * 6).tolist()
        hot = [1.0] * 40 + [2.0, 0.5, 0.5, 3.0] + [4.0] * 30
        rows = [(x, i) for i, x in enumerate(hot)] + [(None, 99), (None, 100)]
        for down in (False, True):
            found = {r.n: (r.v, r.min_rank, r.average_rank) for r in with_ranks(spark.createDataFrame(rows, "v double, n long"), "v", down).collect()}
            want = pd.Series([np.nan if v is None else v for v, _ in rows])
            low, mean = (want.rank(method=m, ascending=not down, na_option="bottom") for m in ("min", "average"))
            assert found == {n: (v, low[i], mean[i]) for i, (v, n) in enumerate(rows)}
        q = {r.n: r.q for r in benjamini_hochberg(spark.createDataFrame([(v and v / 100, n) for v, n in rows], "v double, n long"), "v", "q").collect()}
        known = sorted(v / 100 for v in hot)
        assert all(x is None if v is None else x == pytest.approx(min(1, min(p * len(known) / (i + 1) for i, p in enumerate(known) if p >= v / 100))) for (v, n) in rows for x in [q[n]])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ranks_do_not_compute_a_value_twice(spark):
    @F.pandas_udf("double")
    def shaky(x: pd.Series) -> pd.Series:
        return x * (1 + 1e-15 * np.random.default_rng().random(len(x)))

    df = spark.range(200).select("id", shaky((F.col("id") % 50 + 1.5) / 60).alias("p"))
    rows = benjamini_hochberg(df, "p", "q").collect()
    assert len(rows) == 200 and all(r.q is not None and r.q >= r.p for r in rows)
    assert all(r.min_rank is not None for r in with_ranks(df, "p").collect())


def hand_made(spark):
    rng = np.random.default_rng(0)
    rows = []
    for gene, shift in (("up", 4.0), ("same", 0.0), ("down", -4.0)):
        for cohort in ("tumor", "normal"):
            for s in range(6):
                rows.append((cohort, gene, f"{cohort}{s}", float(5 + (shift if cohort == "tumor" else 0) + rng.standard_normal())))
    rows += [(c, "flat", f"{c}{s}", 3.0) for c in ("tumor", "normal") for s in range(6)]
    rows += [(c, "null", f"{c}{s}", None) for c in ("tumor", "normal") for s in range(6)]
    return spark.createDataFrame(rows, "cohort string, gene string, sample string, value double")


def test_differential(spark):
    got = {r.gene: r for r in stats.differential(hand_made(spark)).collect()}
    assert got["up"].direction == "up" and got["down"].direction == "down" and got["flat"].direction == "ns"
    assert got["flat"].t_stat == 0 and got["flat"].pvalue == 1 and got["flat"].cohens_d == 0
    assert "null" not in got
    for r in got.values():
        assert r.log2fc == pytest.approx(r.mean_tumor - r.mean_normal)


def test_expression_features_are_complete(spark):
    e = hand_made(spark)
    rows = stats.expression_features(e, stats.differential(e)).collect()
    assert len(rows) == 5 and len(rows[0]) == 30
    assert all(v is not None for r in rows for v in r)


def test_cleaning(spark):
    wide = spark.createDataFrame([(" egfr", "1", "1.0", "x"), ("NA", "2", "0", "2"), ("egfr ", "3", "5", "7"), ("", "4", "1", "1"), ("123", "5", "1", "1")], "Hugo_Symbol string, Entrez_Gene_Id string, s1 string, s2 string")
    long = clean.to_long(wide, "Hugo_Symbol", "tumor", ("Entrez_Gene_Id",))
    assert long.count() == 10 and long.filter("value IS NULL").count() == 1
    both = long.unionByName(long.filter("gene <> 'NA'").withColumn("cohort", clean.F.lit("normal")))
    assert [r.gene for r in clean.common_genes(both).collect()] == ["EGFR"]
    with pytest.raises(ValueError):
        clean.require_samples(long, {"tumor": 3})


def network(spark, pairs):
    return spark.createDataFrame([(a, b, 0.9, 0.9) for a, b in pairs], "gene_a string, gene_b string, weight double, abs_weight double")


@pytest.mark.parametrize("local", [True, False])
def test_distances_on_a_path_and_a_star(spark, local):
    nodes = spark.createDataFrame([(x,) for x in "abcdwxyz"], "gene string")
    edges = network(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("w", "x"), ("w", "y")])
    got = {r.gene: r for r in graph.distance_measures(edges, nodes, local_links=100 if local else 0).collect()}
    scale = 1 / (7 * 6)
    assert [got[g].betweenness_centrality for g in "abcdwz"] == pytest.approx([0, 4 * scale, 4 * scale, 0, 2 * scale, 0])
    assert got["a"].closeness_centrality == pytest.approx(3 / 6 * 3 / 7)
    assert got["w"].closeness_centrality == pytest.approx(2 / 2 * 2 / 7) and got["z"].closeness_centrality == 0


def test_betweenness_of_many_nodes_is_exact(spark):
    """Two linked hubs with 2000 and 1200 leaves: more nodes than were searched from all."""
    a, b = 2000, 1200
    pairs = [("a", "b"), *(("a", f"a{i}") for i in range(a)), *(("b", f"b{i}") for i in range(b))]
    nodes = spark.createDataFrame([(x,) for x in {g for p in pairs for g in p}], "gene string")
    got = {r.gene: r.betweenness_centrality for r in graph.distance_measures(network(spark, pairs), nodes).collect()}
    every = (a + b + 1) * (a + b) / 2
    assert got["a"] == pytest.approx((a * (a - 1) / 2 + a + a * b) / every, rel=1e-9)
    assert got["b"] == pytest.approx((b * (b - 1) / 2 + b + a * b) / every, rel=1e-9)
    assert all(v == pytest.approx(0) for g, v in got.items() if len(g) > 1)


@pytest.mark.parametrize("local", [True, False])
def test_eigenvector_of_a_triangle(spark, local):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "gene string")
    edges = network(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    got = [r.eigenvector_centrality for r in graph.eigenvector(edges, nodes, local_links=100 if local else 0).collect()]
    assert got == pytest.approx([3**-0.5] * 3, abs=1e-5)


def test_triangle_and_components(spark):
    edges = network(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    assert {r.gene: round(r.clustering_coefficient, 6) for r in graph.clustering(edges).collect()} == {"a": 1, "b": 1, "c": round(1 / 3, 6), "d": 0}
    nodes = spark.createDataFrame([(x,) for x in "abcdz"], "gene string")
    assert {r.gene: (r.component_size, r.in_largest_component) for r in graph.component_table(edges, nodes).collect()} == dict.fromkeys("abcd", (4, 1)) | {"z": (1, 0)}


@pytest.mark.parametrize("policy", ["propagate", "pairwise"])
def test_correlation_blocks(spark, policy):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, 9))
    x[1] = x[0] + 0.01
    x[2] = -x[0]
    rows = [(f"g{i:02}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows[3][1][4] = None
    df = spark.createDataFrame(rows, "gene string, values array<double>")
    got = {(r.gene_a, r.gene_b): r.correlation for r in graph.correlation_edges(df, 0.5, nan_policy=policy, block=5).collect()}
    x[3, 4] = np.nan
    want = {}
    for i in range(12):
        for j in range(i + 1, 12):
            good = np.isfinite(x[i]) & np.isfinite(x[j])
            if policy == "pairwise" or good.all():
                r = np.corrcoef(x[i][good], x[j][good])[0, 1]
                if abs(r) >= 0.5:
                    want[f"g{i:02}", f"g{j:02}"] = r
    assert got == pytest.approx(want)


def test_metrics_edges(spark):
    shape = "gene string, score double, label int"
    df = spark.createDataFrame([("a", 0.9, 1), ("b", 0.9, 0), ("c", 0.4, 1), ("d", 0.1, 0)], shape)
    assert metrics.auroc(df).first()[0] == pytest.approx(0.625)
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    only = df.filter("label = 1")
    assert metrics.auroc(only).first()[0] is None and metrics.evaluate(only, "m").first()["auprc"] == 1.0
    assert metrics.best_threshold(df).first()[0] == 0.4


def test_ranking_invariants(spark):
    df = spark.createDataFrame([(f"g{i}", (i % 5) / 5, i % 3 == 0) for i in range(20)], "gene string, score double, label boolean").withColumn("label", clean.F.col("label").cast("int"))
    rows = metrics.rank_genes(df.select("gene", "score"), df.select("gene", "label")).collect()
    assert all(a.rank <= b.rank for a, b in zip(rows, rows[1:])) and rows[0].predicted_prob == 0.8
    assert all(r.novel_candidate == (r.predicted_prob >= 0.5 and r.label == 0) for r in rows)


def test_enrichment_of_the_right_set(spark):
    genes = [f"g{i}" for i in range(100)]
    table = lambda x: spark.createDataFrame([(g,) for g in x], "gene string")
    sets = spark.createDataFrame([("hit", g) for g in genes[:10]] + [("other", g) for g in genes[50:70]] + [("few", g) for g in genes[:2]], "pathway string, gene string")
    got = {r.pathway: r for r in enrich.enrich(table(genes[:12]), sets, table(genes)).collect()}
    assert set(got) == {"hit"} and got["hit"].overlap == "10/10"
    assert got["hit"].pvalue == pytest.approx(math.comb(12, 10) / math.comb(100, 10))


def learning(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i}", *(rng.standard_normal(3) + (2 if i % 4 == 0 else 0)).tolist(), int(i % 4 == 0)) for i in range(120)]
    return spark.createDataFrame(rows, "gene string, a double, b double, c double, label int")


def test_models_learn(spark):
    df = features.split(learning(spark))
    train, test = df.filter("NOT is_test").drop("is_test"), df.filter("is_test").drop("is_test")
    for model in (ml.models()["logistic_regression"], ml.ExtraTrees(20), ml.models(trees=10)["random_forest"], ml.RbfSvm(64)):
        scored = model.fit(train, ["a", "b", "c"]).score(test)
        assert metrics.auroc(scored).first()[0] > 0.8
    assert ml.smote(train, ["a", "b", "c"]).groupBy("label").count().select("count").distinct().count() == 1


def test_feature_tables(spark):
    df = learning(spark).withColumn("d", clean.F.col("a") * 2).withColumn("flat", clean.F.lit(1.0)).drop("label")
    assert features.drop_constant(df).columns == ["gene", "a", "b", "c", "d"]
    assert features.correlated_pairs(df.drop("flat")).first()["pearson_r"] == 1.0
    assert features.drop_collinear(df.drop("flat")).columns == ["gene", "a", "b", "c"]
    assert len(ml.project(df, ["a", "b", "c"]).columns) == 3

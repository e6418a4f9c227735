import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import features, ml, plots
from tessera.plans import cli


def test_overlap_regions_list_empty_ones(spark):
    some = spark.createDataFrame([("a",), ("b",), ("b",)], "gene string")
    assert {r.region: r.n for r in plots.overlap_regions(some, some.limit(0)).collect()} == {"case only": 2, "both": 0, "control only": 0}
    assert {r.region: r.n for r in plots.overlap_regions(some, some.filter("gene = 'b'")).collect()} == {"case only": 1, "both": 1, "control only": 0}


@pytest.mark.parametrize(("values", "counts"), [([], {}), ([2.0, 2.0, None, float("nan")], {50: 2}), ([0.0, 0.5, 1.0, float("inf")], {0: 1, 50: 1, 99: 1})])
def test_change_histogram_holds_every_finite_change(spark, values, counts):
    de = spark.createDataFrame([(v,) for v in values], "log2fc double")
    rows = plots.change_histogram(de).collect()
    assert len(rows) == 100 and {r.bin: r.n for r in rows if r.n} == counts


def test_short_lists_break_ties_by_name(spark):
    de = spark.createDataFrame([("b", True, 0.01, -2.0), ("a", True, 0.01, 2.0), ("c", True, 0.01, 3.0), ("d", False, 0.001, 9.0)], "gene string, significant boolean, pvalue_adj double, log2fc double")
    assert [r.gene for r in plots.first_significant(de, 2).collect()] == ["c", "a"]
    paths = spark.createDataFrame([("y", 0.01), ("x", 0.01), ("z", 0.2), ("w", None)], "pathway string, padj double")
    assert [r.pathway for r in plots.top_pathways(paths).collect()] == ["x", "y"]


def test_joins_keep_genes_without_a_partner(spark):
    ranking = spark.createDataFrame([("a", 0.9, 1, 1, False), ("b", 0.8, 2, 0, True)], "gene string, predicted_prob double, rank int, label int, novel_candidate boolean")
    de = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "gene string, log2fc double")
    assert {r.gene: r["rank"] for r in plots.ranked_differential(de, ranking).collect()} == {"a": 1, "z": None}
    links = spark.createDataFrame([("a", "c", 0.5)], "gene_a string, gene_b string, abs_weight double")
    degree = spark.createDataFrame([("a", 1)], "gene string, degree long")
    assert {(r.gene, r.degree, r.category) for r in plots.degree_against_rank(ranking, degree).collect()} == {("a", 1, "known"), ("b", 0, "novel")}
    one = plots.run_summary(ranking, links).first()
    assert (one.n_genes, one.n_known, one.n_novel, one.n_edges) == (2, 1, 1, 1) and math.isclose(one.mean_prob, 0.85)
    assert {r.label: r.share for r in plots.class_balance(ranking).collect()} == {0: 0.5, 1: 0.5}


def test_importance_groups_and_selection(spark):
    table = ml.importance_table(spark, {"m": {"tumor_mean": 3.0, "tumor_std": 1.0, "degree": 2.0, "own": 0.0}})
    groups = {r.feature_group: r.features for r in plots.group_importance(table).collect()}
    assert groups == {"Tumor Expression Stats": 2, "Network Topology": 1, "Other": 1}
    assert features.selected(table, 2) == ["tumor_mean", "degree"]


def test_trimming_keeps_known_genes_and_those_without_score(spark):
    train = spark.createDataFrame([("a", 1, 5), ("b", 0, 6), ("c", 0, 7), ("d", 0, 8)], "gene string, label int, x int")
    scores = spark.createDataFrame([("a", 0.99), ("b", 0.95), ("c", 0.1)], "gene string, score double")
    kept = features.trim_unlabelled(train, scores)
    assert kept.columns == train.columns and {r.gene for r in kept.collect()} == {"a", "c", "d"}


def test_cache_clear_leaves_other_folders(tmp_path):
    for name in ("0123456789abcdef", "mine"):
        (tmp_path / name).mkdir()
    assert cli.main(["cache", "clear", "--output", str(tmp_path)]) == 0
    assert [p.name for p in tmp_path.iterdir()] == ["mine"]


def test_correlated_pairs_are_of_rows_with_both(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame({"a": rng.normal(1e6, 1, 300)})
    x["b"], x["c"], x["d"] = x.a + rng.normal(0, 0.1, 300), -3 * x.a, 7.3
    x.loc[:40, "b"] = None
    x["gene"] = [str(i) for i in range(300)]
    rows = spark.createDataFrame(x.astype(object).where(x.notna(), None), "a double, b double, c double, d double, gene string").repartition(5)
    got = {(r.feature_a, r.feature_b): r.pearson_r for r in features.correlated_pairs(rows, 0.9).collect()}
    both = x.b.notna()
    want = {("a", "b"): np.corrcoef(x.a[both], x.b[both])[0, 1], ("a", "c"): -1.0, ("b", "c"): np.corrcoef(x.b[both], x.c[both])[0, 1]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in got)
    assert features.correlated_pairs(rows.limit(0)).count() == 0 and features.correlated_pairs(rows.select("gene")).count() == 0

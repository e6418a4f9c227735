import pytest

from tessera.config import EngineConfig
from tessera.operators import graph, ml
from tessera.plans import catalog, report
from tessera.plans.engine import Engine, Inputs


class Caught(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "of"),
    [("m07_random_forest", "random_forest"), ("m08_gradient_boosting", "gradient_boosting"), ("m10_extra_trees", "extra_trees"), ("m11_rbf_svm", "rbf_svm")],
)
def test_learning_queries_take_the_operators_models(spark, monkeypatch, name, of):
    seen = []

    def fit(self, train, columns):
        seen.append((self, columns))
        raise Caught

    for kind in (ml.Classifier, ml.ExtraTrees, ml.RbfSvm):
        monkeypatch.setattr(kind, "fit", fit)
    with pytest.raises(Caught):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    model, columns = seen[0]
    assert columns == [f"f{i}" for i in range(64)]
    if of == "random_forest":
        assert model.estimator.getNumTrees() == 500
    elif of == "gradient_boosting":
        assert model.estimator.getMaxIter() == 300
    else:
        assert (model.trees if of == "extra_trees" else model.width) == (500 if of == "extra_trees" else 200)


def test_cross_validation_and_importance_queries_are_whole(spark, monkeypatch):
    def cross_validate(df, columns, chosen, *rest):
        assert len(columns) == 64 and set(chosen) == set(ml.models()) and df.select("cv_fold").distinct().count() == 5
        raise Caught

    def permutation_importance(model, df, columns, repeats=10, seed=42):
        assert len(columns) == 64 and repeats == 10
        raise Caught

    monkeypatch.setattr(ml, "cross_validate", cross_validate)
    monkeypatch.setattr(ml, "permutation_importance", permutation_importance)
    for name in ("m14_m16_cross_validation", "m20_m21_importance"):
        with pytest.raises(Caught):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


class Sum:
    """A model whose score is the sum of its columns."""

    def score(self, df):
        return df.selectExpr("gene", "label", "a + b + c AS score")


def test_engine_permutes_ten_times(spark, tmp_path):
    rows = [(f"g{i}", float(i * 7 % 10), float(i * 3 % 10), float(i * 9 % 13), int(i * 7 % 10 + i * 3 % 10 > 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "gene string, a double, b double, c double, label int")
    engine = Engine(spark, Inputs(df, df), EngineConfig(output=str(tmp_path)))
    df.write.parquet(f"{engine.path('holdout')}.parquet")
    df.drop("label").write.parquet(f"{engine.path('features')}.parquet")
    engine.fitted = ("sum", Sum())
    got = {r.feature: r.permutation for r in engine._importance()["feature_importance"].collect()}
    drops = {r.feature: max(r.importance, 0.0) for r in ml.permutation_importance(Sum(), df, ["a", "b", "c"], 10, 42).collect()}
    low, high = min(drops.values()), max(drops.values())
    assert got == pytest.approx({f: (v - low) / (high - low) for f, v in drops.items()})


def test_figures_draw_whole_curves_and_all_genes(spark, monkeypatch):
    n = 5000
    inf = float("inf")
    genes = [(f"g{i}", i / n - 0.5, inf if i == 0 else None if i == 1 else i / 100, "up" if i > n // 2 else "ns") for i in range(n)]
    points = [(1 - i / n, (i + 1) / n, (i + 1) / n, 1.0) for i in range(n)]
    tables = {
        "de_results": spark.createDataFrame(genes, "gene string, log2fc double, neg_log10_padj double, direction string"),
        "roc": spark.createDataFrame(points, "score double, fpr double, tpr double, _ double").drop("_"),
        "pr": spark.createDataFrame(points, "score double, _ double, recall double, precision double").drop("_"),
    }
    other = spark.createDataFrame([("a", "b", "c", 1, 0.5, 1, 0.5, "f", "g", 0.5)], "dataset string, stage string, model string, n_genes int, mean_auprc double, rank int, mean_importance double, feature string, gene string, predicted_prob double")
    tables["nodes"] = spark.createDataFrame([("c",), ("d",), ("e",)], "gene string")
    tables["gene_rankings"] = spark.createDataFrame([("c", 1, 0.5), ("d", 2, 0.5)], "gene string, rank int, predicted_prob double")
    tables["annotated_edges"] = spark.createDataFrame([("c", "d", -0.8, 0.8), ("d", "e", 0.8, 0.8)], "gene_a string, gene_b string, weight double, abs_weight double")
    engine = type("Tables", (), {"table": lambda self, name: tables.get(name, other)})()
    drawn = {}
    monkeypatch.setattr(report, "svg_scatter", lambda points, title: drawn.setdefault(title, points) and title)
    page = report.figures(engine)["Network"]
    assert page.count("<circle") == 2 and page.count("<line") == 1
    for title in ("ROC", "Precision and recall"):
        x = [p[0] for p in drawn[title]]
        assert len(x) == 2000 and x[0] == pytest.approx(1 / n) and x[-1] == 1.0
        assert max(b - a for a, b in zip(x, x[1:])) <= 3.01 / n
    volcano = drawn["log2 fold change against -log10 adjusted p"]
    assert {c for _, _, c in volcano} == {report.COLOURS["up"], report.COLOURS["ns"]}
    assert min(p[0] for p in volcano) < -0.49
    assert report.in_cells(report.volcano(tables["de_results"])).agg({"n": "sum"}).first()[0] == n


def test_layout_takes_the_best_ranked(spark):
    nodes = spark.createDataFrame([(i,) for i in range(200)], "gene long")
    edges = spark.createDataFrame([(i, i + 1, 0.5, 0.5) for i in range(199)], "gene_a long, gene_b long, weight double, abs_weight double")
    ranking = spark.createDataFrame([(i, None if i == 199 else (200 - i) // 2) for i in range(201)], "gene long, rank int")
    got = {r.gene for r in graph.spring_layout(edges, nodes, ranking, most=4).collect()}
    assert got == {197, 198, 195, 196}
    assert len({r.gene for r in graph.spring_layout(edges, nodes, ranking).collect()} & set(range(49, 199))) == 150

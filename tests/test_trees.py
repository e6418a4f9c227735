import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tessera.operators import ml


def table(spark, rows=300):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((rows, 3)) + (np.arange(rows) % 4 == 0)[:, None]
    return spark.createDataFrame([(f"g{i}", *v, int(i % 4 == 0)) for i, v in enumerate(x.tolist())], "gene string, a double, b double, c double, label int")


def test_trees_stay_off_the_driver_and_shares_add_up(spark, monkeypatch):
    def caught(self):
        raise AssertionError("a table came to the driver")

    monkeypatch.setattr(DataFrame, "toPandas", caught)
    df = table(spark)
    model = ml.ExtraTrees(12).fit(df, ["a", "b", "c"])
    whole = {r.gene: r.score for r in model.score(df).collect()}
    monkeypatch.setattr(ml, "SHARE", 5000)
    assert len(model.shares()) > 1
    assert {r.gene: r.score for r in model.score(df).collect()} == pytest.approx(whole)
    assert all(abs(whole[r.gene] - r.label) < 1e-12 for r in df.collect())  # grown until each leaf is of one class
    assert sum(model.importance().values()) == pytest.approx(1)


def test_trees_of_constant_or_one_sided_rows_are_leaves():
    rng = np.random.default_rng(1)
    for x, y in ((np.ones((4, 2)), np.array([0.0, 1, 0, 1])), (rng.random((4, 2)), np.zeros(4))):
        tree = ml._grow(x, y, np.ones(4), rng, 1, 40)
        assert len(tree) == 1 and np.allclose(ml._vote(tree, x), y.mean())


def test_folds_are_resampled_once_for_all_models(spark, monkeypatch):
    calls, undersample = [], ml.features.undersample
    monkeypatch.setattr(ml.features, "undersample", lambda *x: calls.append(1) or undersample(*x))
    df = ml.features.folds(table(spark, 90), 3)
    found = ml.cross_validate(df, ["a", "b", "c"], {"few": ml.ExtraTrees(3), "more": ml.ExtraTrees(9)}).collect()
    assert [(r.model, r.cv_fold) for r in found] == [(m, f) for m in ("few", "more") for f in (1, 2, 3)]
    assert len(calls) == 3 and all(r.auroc > 0.5 for r in found)


def test_fold_fits_are_those_of_spark(spark):
    """Without random draws forests and boosting from arrays say what Spark ML says; with them no job is taken for a level."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 3)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.5 * rng.standard_normal(400) > 0.3).astype(int)
    df = spark.createDataFrame([(f"g{i}", *v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "gene string, a double, b double, c double, label int").coalesce(1).cache()
    weight = {"weightCol": "weight", "labelCol": "label", "featureSubsetStrategy": "all"}
    for estimator in (ml.GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.05, **weight), ml.RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=6, **weight)):
        model = ml.Classifier(estimator)
        want = {r.gene: r.score for r in model.fit(df, ["a", "b", "c"]).score(df).collect()}
        fitted = ml.fit_fold(model, df, 400, ["a", "b", "c"])
        assert isinstance(fitted, ml.ExtraTreesModel)
        assert {r.gene: r.score for r in fitted.score(df).collect()} == pytest.approx(want)
    seen = ml.models(trees=40, rounds=30)
    spark.sparkContext.setJobGroup("folds", "folds")
    for name in ("random_forest", "gradient_boosting"):
        got = ml.fit_fold(seen[name], df, 400, ["a", "b", "c"]).score(df)
        assert ml.metrics.auroc(got).first()[0] > 0.85
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds")) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

import numpy as np

from tessera.llm.quality import classify_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from tessera.llm.queries import QUERIES

    rows = QUERIES["op2_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = np.array([r.quality for r in rows])
    predicted = np.array([r.predicted for r in rows])
    assert predicted[good == 1].mean() >= 0.97
    assert (predicted == good).mean() >= 0.95


def test_same_score_whatever_the_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'a' AS source", "1.0 AS score", "2 AS quality").repartition(5)
    a = {r.doc_id: r.score for r in classify_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in classify_quality(other, labels).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-5
    assert all(0 <= x <= 1 for x in a.values())


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(
        [(i, "fine words in a row here" if i % 2 else "!!! ### !!!") for i in range(1, 60)] + [(100, None), (101, ""), (101, "x"), (None, "y"), (102, "word " * 100_000)], "doc_id long, text string"
    )
    rows = classify_quality(docs, labels).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.predicted for r in rows if r.doc_id and r.doc_id < 60} == {i: i % 2 for i in range(1, 60)}
    assert classify_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in classify_quality(docs, labels.limit(0)).collect()} == {0.5}

import gzip

from tessera.config import EngineConfig
from tessera.operators import ml, stats
from tessera.plans import cli
from tessera.plans.engine import Engine, Inputs
from tessera.sources import readers, sinks
from tessera.streaming import moments


def test_readers(spark, tmp_path):
    (tmp_path / "case.tsv").write_text("Hugo_Symbol\tEntrez_Gene_Id\ts1\ts2\nA\t1\t1.5\tbad\n\t2\t1\t2\n")
    rows = {(r.gene, r.sample): r.value for r in readers.case_matrix(spark, str(tmp_path / "case.tsv")).collect()}
    assert rows == {("A", "s1"): 1.5, ("A", "s2"): None}
    with gzip.open(tmp_path / "control.gct.gz", "wt") as f:
        f.write("#1.2\n2\t2\nName\tDescription\tn1\tn2\nE1\tA\t1\t2\nE2\tB\t3\t4\n")
    rows = {(r.gene, r.sample): r.value for r in readers.control_matrix(spark, str(tmp_path / "control.gct.gz")).collect()}
    assert rows == {("A", "n1"): 1, ("A", "n2"): 2, ("B", "n1"): 3, ("B", "n2"): 4}
    (tmp_path / "meta.tsv").write_text("# a\n# b\npatient_id\tage\tnone\ns1\t5\t\n\t\t\n")
    meta = readers.case_metadata(spark, str(tmp_path / "meta.tsv"))
    assert meta.columns == ["sample_id", "age"] and meta.count() == 1
    (tmp_path / "samples.tsv").write_text("SAMPID\tSMAFRZE\tANALYTE_TYPE\tSMRIN\nx\tRNASEQ\tRNA:Total RNA\t7\ny\tOTHER\tRNA:Total RNA\t7\n")
    assert [r.sample_id for r in readers.control_metadata(spark, str(tmp_path / "samples.tsv")).collect()] == ["x"]
    (tmp_path / "labels.tsv").write_text("genesymbol\tnote\n egfr\t1\nEGFR \t2\n\t3\n")
    assert [r.gene for r in readers.label_genes(spark, str(tmp_path / "labels.tsv")).collect()] == ["EGFR"]
    assert readers.optional_csv(spark, str(tmp_path / "none.csv")) is None


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("A & B", 0.5, True, None), ("C", float("inf"), False, "x")], "gene string, p double, known boolean, note string")
    edges = spark.createDataFrame([("A & B", "C", -0.75, 0.75)], "gene_a string, gene_b string, weight double, abs_weight double")
    sinks.export_graph(nodes, edges, str(tmp_path / "g"))
    n, e = readers.graphml(spark, str(tmp_path / "g/graphml"))
    assert {r.gene: (r.p, r.known) for r in n.collect()} == {"A & B": (0.5, True), "C": (0.0, False)}
    assert [(r.gene_a, r.gene_b, r.weight) for r in e.collect()] == [("A & B", "C", -0.75)]
    assert '"links":[{"source":"A & B"' in spark.read.text(str(tmp_path / "g/json")).first()[0]
    assert 'label "A_&_B"' in "".join(r.value for r in spark.read.text(str(tmp_path / "g/gml")).collect())


def test_streaming_moments_equal_the_batch(spark, tmp_path):
    e = readers.synthetic_cohort(spark, 30, 8, 6, 4).withColumn("ts", moments.F.timestamp_seconds(moments.F.lit(0)))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(moments.SCHEMA).parquet(str(tmp_path / "in"))
    q = moments.moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    got = {r.gene: r.t_stat for r in stats.welch(moments.to_cohort_moments(spark.table("moments"))).collect()}
    want = {r.gene: r.t_stat for r in stats.welch(stats.cohort_moments(spark.read.parquet(str(tmp_path / "in")))).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-6 for g in got)


def test_first_stages(spark, tmp_path):
    expr = readers.synthetic_cohort(spark, 60, 14, 12, 20)
    labels = expr.select("gene").distinct().filter("gene < 'GENE00014'")
    config = EngineConfig(output=str(tmp_path / "out"), min_samples_case=5, min_samples_control=5, cutoff=0.6, folds=2, high_confidence=0.5)
    chosen = {"logistic_regression": ml.models()["logistic_regression"]}
    engine = Engine(spark, Inputs(expr, labels), config, chosen)
    out = engine.run(to_stage="differential")
    assert out.failed is None, out.error
    assert engine.table("de_results").count() > 40


def test_command_line(tmp_path, capsys):
    assert cli.main(["info"]) == 0 and "cutoff = 0.7" in capsys.readouterr().out
    assert cli.main(["validate", "--case", "no", "--control", "no2", "--labels", "no3"]) == 1
    (tmp_path / "f").write_text("x")
    f = str(tmp_path / "f")
    assert cli.main(["run", "--case", f, "--control", f, "--labels", f, "--dry-run"]) == 0

"""Scans of matrices, sample metadata, label lists and graphs. Required columns are checked; missing values are null."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clean import drop_blank, number, resolve, to_long

# Names that a label list may use for its gene column, and quality columns of sample attributes.
LABEL_COLUMNS = ["GeneSymbol", "gene_symbol", "gene", "symbol", "hgnc_symbol"]
QC_COLUMNS = ["SMTS", "SMTSD", "SMRIN", "SMATSSCR", "SMRDTTL", "SMMAPRT", "SMRRNART", "SMRDLGTH", "SMNABTCHT", "SMGEBTCHT"]


def read_tsv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def case_matrix(spark: SparkSession, path: str, cohort: str = "tumor") -> DataFrame:
    """Wide TSV with Hugo_Symbol and one column per sample, in long form; Entrez_Gene_Id is dropped."""
    df = read_tsv(spark, path)
    if "Hugo_Symbol" not in df.columns:
        raise ValueError(f"{path} has no column Hugo_Symbol")
    return drop_blank(to_long(df, "Hugo_Symbol", cohort, ("Entrez_Gene_Id",)))


def case_metadata(spark: SparkSession, path: str, id_col: str = "PATIENT_ID") -> DataFrame:
    """Clinical TSV after # comment lines; the id column in any case; rows and columns without any value are dropped."""
    df = read_tsv(spark, path, "#")
    df = df.withColumnRenamed(resolve(df, id_col), "sample_id").na.drop("all")
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()  # one row
    return df.select(*(F.col(f"`{c}`") for c in df.columns if counts[c]))


def control_matrix(spark: SparkSession, path: str, cohort: str = "normal") -> DataFrame:
    """GCT 1.2, plain or gzip: two lines before the header; Name is dropped and Description is the gene.

    The file is read as text: a line's first field tells the header, so no position is needed and the rows can be dealt
    out at once after an unsplittable gzip.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    header = lines.filter((F.col("f")[0] == "Name") & (F.lower(F.col("f")[1]) == "description")).first()
    if header is None:
        raise ValueError(f"{path} has no GCT header")
    samples = header["f"][2:]
    rows = lines.filter((F.size("f") == len(samples) + 2) & (F.col("f")[0] != "Name")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = F.array(*map(F.lit, samples))
    long = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        F.col("f")[1].alias("gene"), "_row", F.explode(F.arrays_zip(names.alias("sample"), F.slice("f", 3, len(samples)).alias("value"))).alias("c")
    )
    return drop_blank(long.select(F.lit(cohort).alias("cohort"), "gene", "_row", F.col("c.sample").alias("sample"), number(F.col("c.value")).alias("value")))


def control_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sample attributes of RNASEQ samples of total RNA, cut to the id and the quality columns that exist."""
    df = read_tsv(spark, path)
    sample = resolve(df, "SAMPID")
    for needed in ("SMAFRZE", "ANALYTE_TYPE"):
        if needed not in df.columns:
            raise ValueError(f"{path} has no column {needed}")
    kept = df.filter((F.col("SMAFRZE") == "RNASEQ") & (F.col("ANALYTE_TYPE") == "RNA:Total RNA"))
    return kept.select(F.col(sample).alias("sample_id"), *(c for c in QC_COLUMNS if c in df.columns))


def label_genes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct, trimmed, upper-case genes of a list, CSV or TSV; the column is found by name."""
    df = read_tsv(spark, path)
    if len(df.columns) == 1 and "," in df.columns[0]:
        df = spark.read.option("header", True).csv(path)
    return df.select(F.upper(F.trim(resolve(df, *LABEL_COLUMNS))).alias("gene")).filter("gene <> ''").distinct()


def query_genes(spark: SparkSession, path: str) -> DataFrame:
    """One gene per line."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("gene")).filter("gene <> ''").distinct()


def own_matrix(spark: SparkSession, path: str, cohort: str) -> DataFrame:
    """CSV with a gene column and one column per sample."""
    df = spark.read.option("header", True).csv(path)
    return drop_blank(to_long(df, resolve(df, "gene"), cohort))


def optional_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with a header, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file with their typed attributes. An exported graph is small; it is parsed on the driver."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    root = ET.fromstring(text)
    name = lambda e: e.tag.rpartition("}")[2]
    kinds = {"double": ("double", float), "float": ("double", float), "long": ("long", int), "int": ("long", int), "boolean": ("boolean", lambda x: x.lower() == "true")}
    keys = {e.get("id"): (e.get("for"), e.get("attr.name"), *kinds.get(e.get("attr.type"), ("string", str))) for e in root if name(e) == "key"}
    graph = next(e for e in root if name(e) == "graph")

    def rows(tag: str, ids: list[str], fields: list[str]) -> DataFrame:
        attributes = [(n, kind) for kind_of, n, kind, _ in keys.values() if kind_of == tag]
        out = []
        for e in graph:
            if name(e) == tag:
                own = {keys[d.get("key")][1]: keys[d.get("key")][3](d.text) for d in e if d.text}
                out.append((*(e.get(i) for i in ids), *(own.get(n) for n, _ in attributes)))
        return spark.createDataFrame(out, ", ".join([f"{f} string" for f in fields] + [f"`{n}` {k}" for n, k in attributes]))

    return rows("node", ["id"], ["gene"]), rows("edge", ["source", "target"], ["gene_a", "gene_b"])


def synthetic_cohort(spark: SparkSession, genes: int = 2000, case: int = 150, control: int = 50, spiked: int = 20, seed: int = 42) -> DataFrame:
    """Lognormal long table with planted effects: of the first `spiked` genes the even ones up 2.5 times, the odd ones down to 0.3."""
    cells = spark.range(genes).withColumnRenamed("id", "g").crossJoin(F.broadcast(spark.range(case + control).withColumnRenamed("id", "s")))
    is_case = F.col("s") < case
    value = F.exp(F.randn(seed) * F.when(is_case, 1.5).otherwise(1.2) + 5)
    effect = F.when(is_case & (F.col("g") < spiked), F.when(F.col("g") % 2 == 0, 2.5).otherwise(0.3)).otherwise(1.0)
    return cells.select(F.when(is_case, "tumor").otherwise("normal").alias("cohort"), F.format_string("GENE%05d", "g").alias("gene"), F.format_string("S%04d", "s").alias("sample"), (value * effect).alias("value"))

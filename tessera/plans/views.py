"""Views of the driver's tables that stand in for expression matrices, sample metadata, labels, scores and gene sets.

Each has the same definition as a Spark plan and as a list of SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clean import log2p1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes, suppliers as samples, return flags as cohorts, with planted effects: of every twenty parts one is
    eight times up and one eight times down in the case cohort."""
    item = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    case, price = F.col("l_returnflag") == "R", F.col("l_extendedprice")
    value = F.when(case & (F.col("l_partkey") % 20 == 0), 8 * price).when(case & (F.col("l_partkey") % 20 == 1), price / 8).otherwise(price)
    rows = item.groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample"), "l_returnflag").agg(F.avg(value).alias("value"))
    return rows.select(F.when(case, "tumor").otherwise("normal").alias("cohort"), "gene", "sample", "value")


RAW = """
raw AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'tumor' ELSE 'normal' END AS cohort, l_partkey AS gene, l_suppkey AS sample,
         avg(CASE WHEN l_returnflag = 'R' AND l_partkey % 20 = 0 THEN 8 * l_extendedprice
                  WHEN l_returnflag = 'R' AND l_partkey % 20 = 1 THEN l_extendedprice / 8 ELSE l_extendedprice END) AS value
  FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2, 3)"""


def expr_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_expr(spark, sf_dir).withColumn("value", log2p1("value"))


EXPR = RAW + ", expr AS (SELECT cohort, gene, sample, log2(value + 1) AS value FROM raw)"


def ev_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as genes, days as samples, daily sums as values; one cohort."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("gene"), F.to_date("ts").cast("string").alias("sample")).agg(F.sum("value").alias("value"))
    return rows.select(F.lit("events").alias("cohort"), "gene", "sample", "value")


EV = """
ev AS (SELECT 'events' AS cohort, user_id AS gene, CAST(CAST(ts AS DATE) AS VARCHAR) AS sample, sum(value) AS value FROM events GROUP BY 2, 3)"""


def emb_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene"), F.col("embedding").cast("array<double>").alias("values"), F.col("label").alias("group"))


EDGES = """
vec AS (SELECT vec_id AS gene, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS s FROM embeddings),
z AS (SELECT gene, s, (v - avg(v) OVER (PARTITION BY gene)) / stddev_samp(v) OVER (PARTITION BY gene) AS z FROM vec),
zz AS (SELECT gene, list(z ORDER BY s) AS l, count(*) AS n FROM z GROUP BY gene),
edges AS (
  SELECT a.gene AS gene_a, b.gene AS gene_b, list_dot_product(a.l, b.l) / (a.n - 1) AS weight,
         abs(list_dot_product(a.l, b.l) / (a.n - 1)) AS abs_weight
  FROM zz a JOIN zz b ON a.gene < b.gene WHERE abs(list_dot_product(a.l, b.l) / (a.n - 1)) >= 0.3),
sym AS (SELECT gene_a AS gene, gene_b AS other, abs_weight FROM edges UNION ALL SELECT gene_b, gene_a, abs_weight FROM edges),
deg AS (SELECT gene, count(*) AS degree FROM sym GROUP BY gene)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known positives: parts of some brands, and a few that no table has."""
    known = table(spark, sf_dir, "part").filter(F.substring("p_brand", -1, 1) == "3").select(F.col("p_partkey").alias("gene"))
    return known.union(spark.range(3).select(-1 - F.col("id")))


LABELS = """
known AS (SELECT p_partkey AS gene FROM part WHERE p_brand[-1:] = '3' UNION ALL SELECT -1 UNION ALL SELECT -2 UNION ALL SELECT -3)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that follows from their length, with ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("gene"), ((F.col("n_chars") * 37 % 211) / 211.0).alias("score"), F.col("toxic").alias("label"))


SCORED = """
scored AS (SELECT doc_id AS gene, (n_chars * 37 % 211) / 211.0::DOUBLE AS score, toxic AS label FROM documents JOIN labels USING (doc_id)),
totals AS (SELECT sum(label) AS pos, count(*) - sum(label) AS neg, count(*) AS n FROM scored),
by_score AS (SELECT score, sum(label) AS p, count(*) AS c FROM scored GROUP BY score),
curve AS (
  SELECT score, p, c - p AS f, sum(p) OVER w AS tp, sum(c - p) OVER w AS fp, pos, neg FROM by_score, totals
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("pathway"), F.col("p_partkey").alias("gene"))

"""The thin queries of the corpus operators and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import encode_decode
from tessera.llm.common import table
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.license_scan import LICENCE_FILE, TEMPLATES, THRESHOLD, WORD, scan_licences, weights
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import classify_quality
from tessera.llm.token_counts import count_tokens
from tessera.llm.url_filter import filter_urls, host_of


def _day(number):
    return F.date_add(F.lit("2022-01-01").cast("date"), number.cast("int"))


def _blocklist(hosts: DataFrame) -> DataFrame:
    """Dated entries for the hosts of a table: some are added, some removed later, some added again, some by path."""
    v = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    rows = hosts.select("host", v.alias("v"))
    parts = [
        rows.filter("v % 4 = 0").select(F.col("host").alias("key"), F.lit("add").alias("action"), _day(F.expr("v % 1000")).alias("at")),
        rows.filter("v % 8 = 0").select("host", F.lit("remove"), _day(F.expr("v % 1000 + 200 + v % 300"))),
        rows.filter("v % 16 = 0").select("host", F.lit("add"), _day(F.expr("v % 1000 + 700"))),
        rows.filter("v % 5 = 1").select(F.concat("host", F.lit("/de")), F.lit("add"), _day(F.expr("v % 1300"))),
        hosts.sparkSession.range(2).select(F.lit("example.org"), F.when(F.col("id") == 0, "add").otherwise("remove"), _day(300 + 200 * F.col("id"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that follows from its id, against a list whose dated entries follow from the hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    captures = pages.withColumn("fetched_at", _day((F.col("page_id") * 7919) % 1460))
    out = filter_urls(captures, _blocklist(hosts))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "listed_since")})


OP1_SQL = r"""
WITH pages_ AS (
  SELECT page_id, url, (DATE '2022-01-01' + ((page_id * 7919) % 1460)::INT) AS fetched_at,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)', 1)), '\.+$', '') AS host,
         regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM pages),
hosts AS (SELECT host, ('0x' || md5(host)[1:4])::INT AS v FROM (SELECT DISTINCT host FROM pages_ WHERE host <> '')),
entries AS (
  SELECT host AS key, 'add' AS action, DATE '2022-01-01' + v % 1000 AS at FROM hosts WHERE v % 4 = 0
  UNION SELECT host, 'remove', DATE '2022-01-01' + v % 1000 + 200 + v % 300 FROM hosts WHERE v % 8 = 0
  UNION SELECT host, 'add', DATE '2022-01-01' + v % 1000 + 700 FROM hosts WHERE v % 16 = 0
  UNION SELECT host || '/de', 'add', DATE '2022-01-01' + v % 1300 FROM hosts WHERE v % 5 = 1
  UNION SELECT 'example.org', 'add', DATE '2022-01-01' + 300 UNION SELECT 'example.org', 'remove', DATE '2022-01-01' + 500),
hits AS (
  SELECT p.page_id, e.key, max_by(e.action, (e.at, e.action)) AS last, max_by(e.at, (e.at, e.action)) AS since
  FROM pages_ p JOIN entries e ON e.at <= p.fetched_at AND (p.host = e.key OR ends_with(p.host, '.' || e.key)
       OR p.host || '/' || p.path = e.key OR starts_with(p.host || '/' || p.path, e.key || '/') AND contains(e.key, '/'))
  GROUP BY 1, 2),
live AS (
  SELECT page_id, count(*) AS n, min_by(key, (-length(key), key)) AS key, min_by(since, (-length(key), key)) AS since
  FROM hits WHERE last = 'add' GROUP BY 1)
SELECT p.page_id, p.url, p.host, p.fetched_at::VARCHAR AS fetched_at, l.n IS NOT NULL AS blocked, coalesce(l.n, 0) AS n_entries,
       l.key AS matched_key, l.since::VARCHAR AS listed_since FROM pages_ p LEFT JOIN live l USING (page_id)
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a tree: source / package / module; each fifth is a licence file."""
    path = F.expr(
        "concat(coalesce(source, ''), '/p', doc_id % 97, CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('/m', doc_id % 7) END, "
        "CASE WHEN doc_id % 5 = 0 THEN '/LICENSE' ELSE concat('/f', doc_id, '.txt') END)"
    )
    return scan_licences(table(spark, sf_dir, "documents").withColumn("path", path))


def _op6_sql() -> str:
    rows, idf, other = weights(TEMPLATES)
    quoted = ", ".join(f"('{a}', '{b}', '{w}', {x!r}::DOUBLE)" for a, b, w, x in rows)
    values = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    return rf"""
WITH vocabulary(licence, template, word, weight) AS (VALUES {quoted}),
known(word, idf) AS (VALUES {values}),
files AS (
  SELECT doc_id, text, concat(coalesce(source, ''), '/p', doc_id % 97, CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('/m', doc_id % 7) END,
         CASE WHEN doc_id % 5 = 0 THEN '/LICENSE' ELSE concat('/f', doc_id, '.txt') END) AS path FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM files),
words AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(line), '{WORD}')) AS word FROM lines),
valued AS (
  SELECT doc_id, pos, word, count(*) * coalesce(any_value(idf), {other!r}::DOUBLE) AS x FROM words LEFT JOIN known USING (word) GROUP BY 1, 2, 3),
norms AS (SELECT doc_id, pos, sqrt(sum(x * x)) AS norm FROM valued GROUP BY 1, 2),
scored AS (
  SELECT doc_id, pos, licence, template, round(sum(x * weight) / any_value(norm), 6) AS score
  FROM valued JOIN vocabulary USING (word) JOIN norms USING (doc_id, pos) GROUP BY ALL),
own AS (SELECT doc_id, min_by(licence, (-score, licence)) AS own_licence, max(score) AS own_score FROM scored WHERE score >= {THRESHOLD} GROUP BY 1),
found AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_licence, own_score FROM files LEFT JOIN own USING (doc_id)),
holders AS (
  SELECT dir, min_by(own_licence, (-own_score, doc_id)) AS licence FROM found
  WHERE own_licence IS NOT NULL AND regexp_matches(path, '{LICENCE_FILE}') GROUP BY 1),
near AS (
  SELECT f.dir, max_by(h.dir, length(h.dir)) AS above, max_by(h.licence, length(h.dir)) AS licence
  FROM (SELECT DISTINCT dir FROM found) f JOIN holders h ON f.dir = h.dir OR h.dir = '' OR starts_with(f.dir, h.dir || '/') GROUP BY 1)
SELECT doc_id, path, own_licence, own_score, coalesce(own_licence, near.licence) AS licence,
       CASE WHEN own_licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own_licence IS NULL THEN near.above END AS from_dir
FROM found LEFT JOIN near USING (dir)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(common.last <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM best
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op6_license_scan": _op6_sql(),
    "op7_line_dedup": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
}

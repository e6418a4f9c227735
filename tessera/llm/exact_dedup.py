"""Exact deduplication by a tree-merge of digest runs, in DataFrame expressions only.

Each input partition is one leaf. Its rows become a run of (digest, best row, count); in round r the runs of
`fan_in` neighbouring groups of partitions meet, are sorted and merged, and one row for each digest goes on. A
digest that a third of all rows share therefore reaches any task at most `fan_in` times a round (the rows of one
partition are merged before they are exchanged), never as a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE_RE, cut, or_empty

KEY = ["_digest", "_length", "_check"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its id, its leaf, the digest of the text without white space, and two checks of it.

    Two texts count as equal when SHA-256, length and a second independent 64-bit hash all agree.
    """
    text = or_empty(text_col)
    return (
        docs.select(F.col(id_col).alias("_id"), F.char_length(text).alias("_chars"), F.regexp_replace(text, f"{WHITE_RE}+", "").alias("_norm"))
        .select(
            "_id",
            "_chars",
            F.spark_partition_id().alias("_leaf"),
            F.unhex(F.sha2("_norm", 256)).alias("_digest"),
            F.char_length("_norm").alias("_length"),
            F.xxhash64("_norm").alias("_check"),
        )
    )


def merge_runs(leaves: DataFrame, fan_in: int) -> DataFrame:
    """Merge the runs of all leaves, `fan_in` at a time, to one row per digest with the row that stays and the count."""
    top = leaves.agg(F.max("_leaf")).first()[0]
    best = F.struct((-F.col("_chars")).alias("rank"), F.col("_id").alias("id"))
    runs = leaves.select("_leaf", *KEY, best.alias("_best"), F.lit(1).cast("long").alias("_size"))
    groups = (top or 0) + 1
    while True:
        runs = (
            runs.withColumn("_leaf", F.floor(F.col("_leaf") / fan_in).cast("int"))
            .groupBy("_leaf", *KEY)
            .agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"))
        )
        groups = -(-groups // fan_in)
        if groups <= 1:
            return runs.drop("_leaf")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Groups of texts that are equal once all of U+0020 and U+0009..U+000D is deleted.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256. The row with the most code points
    in its original text stays, then the smallest id. Null and empty texts are equal to each other and to texts of
    white space only. Rows that repeat an id each count in group_size; all of them are `kept` if that id stays. A null
    id sorts before all others. An empty table gives no rows; other columns of `docs` are ignored, whatever their names.
    """
    rows = cut(digests(docs, id_col, text_col))
    winners = merge_runs(rows, fan_in).select(*KEY, F.col("_best.id").alias("_keep"), "_size")
    return rows.join(winners, KEY).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )

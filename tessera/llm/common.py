"""What the corpus operators share: table readers, durable cuts of lineage, and the white-space set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import cut, ensure_checkpoint_dir

__all__ = ["WHITE", "WHITE_RE", "cut", "ensure_checkpoint_dir", "or_empty", "shuffle_partitions", "table"]

#: White space of every contract: U+0020 and U+0009 to U+000D, as characters.
WHITE = " \t\n\x0b\x0c\r"
#: The same set as a Java regular expression.
WHITE_RE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def or_empty(column: str):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

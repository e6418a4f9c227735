"""Running aggregates and ranks over a whole table without a single-partition window.

A global window would put all rows in one task. Here rows are range-partitioned, written, and ranked or accumulated
inside each partition; totals of partitions (one row each) give every partition its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import cut

FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, by: str, measures: dict[str, tuple[str, str]], descending: bool = False) -> DataFrame:
    """Add inclusive running aggregates in the order of `by`, whose values must be distinct.

    measures: new column -> (fold, column), fold one of sum, min, max.
    """
    order = F.col(by).desc() if descending else F.col(by).asc()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    totals = dealt.groupBy("_part").agg(*(FOLDS[f](c).alias(n) for n, (f, c) in measures.items()))
    starts = F.broadcast(totals.select("_part", *(FOLDS[f](n).over(before).alias(f"_before_{n}") for n, (f, _) in measures.items())))

    def joined(name: str, fold: str, column: str) -> Column:
        own, start = FOLDS[fold](column).over(inside), F.col(f"_before_{name}")
        if fold == "sum":
            return own + F.coalesce(start, F.lit(0))
        return (F.least if fold == "min" else F.greatest)(own, start)  # both skip nulls

    out = dealt.join(starts, "_part").select(*df.columns, *(joined(n, f, c).alias(n) for n, (f, c) in measures.items()))
    return out


def placed(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """All rows, written once, with _part (the task's range of the order), min_rank (1-based) and _ties (rows of that value).

    Nulls come last in either order. Rows are never joined by a value: a floating-point value that is computed a second
    time may differ in its last bit, and a common value would gather in one task. Ranges are of value and row hash, so a
    value that many rows share spreads over several tasks, and its counts are mended from the ends of the ranges.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, order, F.xxhash64(*df.columns)).withColumn("_part", F.spark_partition_id()))
    v = F.col(value)
    ends = dealt.groupBy("_part").agg(
        F.count("*").alias("_n"), F.count(v).alias("_known"), (F.max(v) if descending else F.min(v)).alias("_first"), (F.min(v) if descending else F.max(v)).alias("_low")
    )
    ends = ends.withColumn("_last", F.when(F.col("_known") == F.col("_n"), F.col("_low")))  # null as soon as the range holds one
    held = dealt.join(F.broadcast(ends), "_part")  # a row per task
    sizes = held.groupBy("_part").agg(F.count_if(v.eqNullSafe(F.col("_first"))).alias("_cf"), F.count_if(v.eqNullSafe(F.col("_last"))).alias("_cl"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per task, as are the windows below
    ends = ends.join(sizes, "_part").withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    edge = lambda at, n, c: F.struct(F.col(at).alias("_v"), n.alias("_r"), F.col(c).alias("_c"))
    both = F.array_distinct(F.array(edge("_first", F.col("_offset") + 1, "_cf"), edge("_last", F.col("_offset") + F.col("_n") - F.col("_cl") + 1, "_cl")))
    every = ends.select("_part", F.explode(both).alias("_e")).select("_part", "_e.*")
    whole = Window.partitionBy("_v")
    every = every.select("_part", F.struct("_v", F.min("_r").over(whole).alias("_r"), F.sum("_c").over(whole).alias("_c")).alias("_e"))
    marks = ends.select("_part", "_offset").join(every.groupBy("_part").agg(F.collect_list("_e").alias("_e")), "_part")
    inside, same = Window.partitionBy("_part").orderBy(order), Window.partitionBy("_part", value)
    rows = dealt.withColumns({"_r": F.rank().over(inside), "_c": F.count("*").over(same)}).join(F.broadcast(marks), "_part")
    own = F.filter("_e", lambda e: e["_v"].eqNullSafe(v))  # at most two marks a range
    rank, ties = F.try_element_at(own, F.lit(1))["_r"], F.try_element_at(own, F.lit(1))["_c"]
    return rows.select(*df.columns, "_part", F.coalesce(rank, F.col("_offset") + F.col("_r")).alias("min_rank"), F.coalesce(ties, F.col("_c")).alias("_ties"))


def with_ranks(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """Add min_rank and average_rank of a column's values in the given order; nulls rank after all values."""
    return placed(df, value, descending).select(*df.columns, "min_rank", (F.col("min_rank") + (F.col("_ties") - 1) / 2).alias("average_rank"))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "pvalue_adj") -> DataFrame:
    """Adjusted p-values: the least p * m / rank over this and all higher ranks, at most 1. A null p stays null and isn't counted."""
    rows = placed(df, p)
    m = rows.agg(F.count(p).alias("_m"))
    rank = F.col("min_rank") + F.col("_ties") - 1
    rows = cut(rows.crossJoin(F.broadcast(m)).select(*df.columns, "_part", F.least(F.col(p) * F.col("_m") / rank, F.when(F.col(p).isNotNull(), 1.0)).alias("_q")))
    least = rows.groupBy("_part").agg(F.min("_q").alias("_l"))
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # over a row per task
    least = least.select("_part", F.min("_l").over(after).alias("_after"))
    higher = Window.partitionBy("_part").orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(higher), F.col("_after")))
    return rows.join(F.broadcast(least), "_part").select(*df.columns, found.alias(out))

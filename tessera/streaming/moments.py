"""Streaming differential statistics: running moments of long-form expression, from which Welch's test follows at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "cohort string, gene string, sample string, value double, ts timestamp"


def moments(stream: DataFrame, watermark: str | None = None, window: str | None = None) -> DataFrame:
    """count, sum and sum of squares of each cohort and gene, in event-time windows if asked for; late rows fall to the watermark."""
    rows = stream.withWatermark("ts", watermark) if watermark else stream
    keys = ["cohort", "gene"] + ([F.window("ts", window)] if window else [])
    v = F.col("value")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def to_cohort_moments(table: DataFrame, case: str = "tumor", control: str = "normal") -> DataFrame:
    """The columns that the batch test takes: n, mean and sample variance of each gene in both cohorts."""
    of = lambda c, x: F.max(F.when(F.col("cohort") == c, F.col(x)))
    wide = table.groupBy("gene").agg(*(of(c, x).alias(f"{x}{i}") for i, c in (("1", case), ("2", control)) for x in ("n", "s", "q")))
    cols = {}
    for i in "12":
        n, s, q = F.coalesce(f"n{i}", F.lit(0)), F.col(f"s{i}"), F.col(f"q{i}")
        cols |= {f"n{i}": n, f"m{i}": F.try_divide(s, n), f"v{i}": F.when(n > 1, F.greatest(F.try_divide(q - s * s / n, n - 1), F.lit(0.0)))}
    return wide.select("gene", *(v.alias(k) for k, v in cols.items()))

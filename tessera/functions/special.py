"""Special functions that Spark lacks, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of Lanczos' approximation of the gamma function for g = 7, n = 9.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0."""
    z = np.asarray(x, float) - 1
    total = np.full_like(z, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total += c / (z + i)
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + step * d)
            c = guard(1 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b) with rest = 1 - x given apart, so that neither end loses digits."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        scale = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log(rest))
        low = x <= (a + 1) / (a + b + 2)
        aa, bb, xx = np.where(low, a, b), np.where(low, b, a), np.where(low, x, rest)
        value = scale * _fraction(aa, bb, xx) / aa
    out = np.where(low, value, 1 - value)
    return np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, out))


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    square = np.asarray(t, float) ** 2
    return incomplete_beta(np.asarray(df, float) / 2, np.full(len(square), 0.5), df / (df + square), square / (df + square))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Column form of student_two_sided; null where an input is missing or the degrees of freedom aren't positive."""
    tt, dd = t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)
    good = np.isfinite(tt) & np.isfinite(dd) & (dd > 0)
    out = np.full(len(tt), np.nan)
    if good.any():
        out[good] = student_two_sided(tt[good], dd[good])
    return pd.Series(out).where(good, None)


#: Terms of hypergeometric tails laid out at once (a row's own terms always are).
TERMS = 1_000_000


@F.pandas_udf(DoubleType())
def hypergeometric_tail(hits: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= hits) for `drawn` draws without replacement from `total` things of which `marked` count."""
    k, n, m, t = (x.to_numpy(float) for x in (hits, drawn, marked, total))
    choose = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)
    out, low = np.zeros(len(k)), np.maximum(np.maximum(k, n + m - t), 0)
    size = np.maximum(np.minimum(n, m) - low + 1, 0).astype(np.int64)  # terms of each row
    rows = np.flatnonzero(size)
    upto = np.cumsum(size[rows])
    for lot in np.split(rows, np.searchsorted(upto, np.arange(TERMS, upto[-1], TERMS))) if len(rows) else ():
        if len(lot):
            start = np.cumsum(size[lot]) - size[lot]
            row = np.repeat(lot, size[lot])
            x = low[row] + np.arange(len(row)) - np.repeat(start, size[lot])
            out[lot] = np.add.reduceat(np.exp(choose(m[row], x) + choose(t[row] - m[row], n[row] - x) - choose(t[row], n[row])), start)
    return pd.Series(np.minimum(out, 1.0))

"""Scalar column functions shared by every family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den, fill: float | None = None) -> Column:
    """num / den with a zero denominator giving null, or ``fill`` when one is passed."""
    out = F.when(c(den) != 0, c(num) / c(den))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def finite(x) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c(x)) & (F.abs(c(x)) != float("inf")), c(x))


def flag(cond: Column) -> Column:
    """0/1 with unknown counted as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def clip(x, lo=None, hi=None) -> Column:
    out = c(x)
    if lo is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(lo)))
    if hi is not None:
        out = F.when(out.isNotNull(), F.least(out, F.lit(hi)))
    return out


def sign3(up: Column, down: Column) -> Column:
    """1 / -1 / 0 from two conditions."""
    return F.when(up, 1).when(down, -1).otherwise(0)


def proximity(distance, threshold: float = 2.0) -> Column:
    """1 at distance <= 0 falling linearly to 0 at the threshold; unknown counts as 0."""
    return F.coalesce(1.0 - clip(distance, 0.0, threshold) / threshold, F.lit(0.0))


def depth_quality(x) -> Column:
    """Retracement depth score: rises to 0.15, flat to 0.65, falls to 0 at 1."""
    x = c(x)
    return (F.when(x.isNull() | (x <= 0), 0.0).when(x < 0.15, x / 0.15).when(x <= 0.65, 1.0)
            .when(x <= 1.0, 1.0 - (x - 0.65) / 0.35).otherwise(0.0))


def bounded(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    return clip(x, lo, hi)


def mean_of(*cols: Column) -> Column:
    """Row mean over the non-null columns."""
    arr = F.array_compact(F.array(*[c(x).cast("double") for x in cols]))
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(arr) > 0, F.size(arr))


def nearest(levels: Column, price: Column) -> Column:
    """Signed distance price - level of the closest level."""
    d = F.transform(levels, lambda x: F.struct(F.abs(price - x).alias("a"), (price - x).alias("d")))
    return F.array_min(F.filter(d, lambda s: s["a"].isNotNull()))["d"]


def above(levels: Column, price: Column) -> Column:
    return F.array_min(F.transform(F.filter(levels, lambda x: x > price), lambda x: x - price))


def below(levels: Column, price: Column) -> Column:
    return F.array_min(F.transform(F.filter(levels, lambda x: x < price), lambda x: price - x))


def within_count(levels: Column, price: Column, dist: Column) -> Column:
    return F.size(F.filter(levels, lambda x: F.abs(x - price) <= dist))


def overlap_share(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Shared part of two intervals over the smaller width."""
    width = F.least(c(a_hi) - c(a_lo), c(b_hi) - c(b_lo))
    inter = F.greatest(F.least(c(a_hi), c(b_hi)) - F.greatest(c(a_lo), c(b_lo)), F.lit(0.0))
    return F.when(width > 0, inter / width).otherwise(0.0)


def true_range(frame) -> Column:
    """Largest of the three ranges; the first bar has only its own range."""
    prev = frame.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def pct(frame, x, k: int = 1) -> Column:
    prev = frame.lag(x, k)
    return F.when(prev != 0, c(x) / prev) - 1

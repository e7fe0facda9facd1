"""Top-k, spines and other row selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys, order, k: int, name: str = "rank") -> DataFrame:
    """First k rows per key; the rank limit is applied before the shuffle as well as after it."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def spine(bars: DataFrame, seconds: int, keys=("symbol",), ts: str = "ts", chunk: int = 4096) -> DataFrame:
    """Every grid slot between a key's first and last bar; expanded chunk by chunk so no task holds a whole history."""
    ends = bars.groupBy(*keys).agg(F.unix_timestamp(F.min(ts)).alias("_a"), F.unix_timestamp(F.max(ts)).alias("_b"))
    step = seconds * chunk
    chunks = ends.select(*keys, "_a", "_b", F.explode(F.sequence(F.col("_a"), F.col("_b"), F.lit(step))).alias("_s"))
    chunks = chunks.repartition(*keys, "_s")
    stop = F.least(F.col("_s") + step - seconds, F.col("_b"))
    slots = chunks.select(*keys, F.explode(F.sequence("_s", stop, F.lit(seconds))).alias("_t"))
    return slots.select(*keys, F.timestamp_seconds("_t").alias("slot"))


def quantile_bins(df: DataFrame, value: str, ties, k: int, name: str) -> DataFrame:
    """``ntile`` over the whole table without one global window: range partitions are numbered by their offsets."""
    # a fixed number of approximate cut values, used only to spread the rows; the ranks themselves are exact
    cuts = sorted(set(df.approxQuantile(value, [i / 64.0 for i in range(1, 64)], 0.01)))
    part = df.withColumn("_p", sum((F.when(F.col(value) >= x, 1).otherwise(0) for x in cuts), F.lit(0)))
    w = Window.partitionBy("_p").orderBy(value, *ties)
    ranked = part.withColumn("_r", F.row_number().over(w))
    sizes = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    out = ranked.join(F.broadcast(base), "_p").crossJoin(F.broadcast(total))
    i, t = F.col("_b") + F.col("_r") - 1, F.col("_t")
    big, rest = F.floor(t / k), t % k
    # the first ``rest`` bins hold one more row
    cut = rest * (big + 1)
    bin_ = F.when(i < cut, F.floor(i / (big + 1))).otherwise(rest + F.floor((i - cut) / F.greatest(big, F.lit(1))))
    return out.withColumn(name, (bin_ + 1).cast("long")).drop("_p", "_r", "_b", "_t")

"""Exact interpolated quantiles by range refinement: no task ever holds a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.store import saved

BINS = 512  #: ranges counted a round
SMALL = 10_000  #: open ranges that are broadcast; more are joined by key


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """(keys, one column a name): the quantile of each (value, probability), linear between neighbours; nulls and NaN are left out.

    Each rank starts with its key's whole range. A round counts values in ``BINS`` parts of the range, map-side, and keeps the least and largest value
    of the part that holds the rank, until both are equal. Keys without a value are absent; keys must not be null.
    """
    keys = list(keys)
    at = [*keys, "_name"]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), x.cast("double").alias("_v")) for n, (x, _) in wanted.items()])).alias("_s")).select(*keys, "_s.*")
    long = saved(long.filter(c("_v").isNotNull() & ~F.isnan("_v")), "values")
    place = F.create_map(*(F.lit(x) for n, (_, p) in wanted.items() for x in (n, float(p))))[c("_name")] * (c("_n") - 1)
    size = long.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_h", place)
    ranks = F.array(F.floor("_h"), F.least(F.floor("_h") + 1, c("_n") - 1))
    state = saved(size.select(*at, F.posexplode(ranks).alias("_t", "_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), (c("_h") - F.floor("_h")).alias("_share")), "ranks")
    while True:
        open_ = state.filter("_lo < _hi")
        n = open_.count()
        if not n:
            break
        hit = long.join(F.broadcast(open_) if n <= SMALL else open_, at).filter(c("_v").between(c("_lo"), c("_hi")))
        part = F.least(F.floor((c("_v") - c("_lo")) / (c("_hi") - c("_lo")) * BINS), F.lit(BINS - 1))
        bins = hit.groupBy(*at, "_t", "_rank", "_below", "_share", part.alias("_bin")).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_k").over(Window.partitionBy(*at, "_t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows at most
        bins = bins.withColumn("_upto", c("_below") + upto).filter((c("_upto") > c("_rank")) & (c("_upto") - c("_k") <= c("_rank")))
        found = bins.select(*at, "_t", "_rank", "_lo", "_hi", (c("_upto") - c("_k")).alias("_below"), "_share")
        state = saved(state.filter("_lo >= _hi").unionByName(found), "ranks")
    ends = state.groupBy(*at).agg(F.max(F.when(c("_t") == 0, c("_lo"))).alias("_a"), F.max(F.when(c("_t") == 1, c("_lo"))).alias("_b"), F.max("_share").alias("_share"))
    value = c("_a") + (c("_b") - c("_a")) * c("_share")
    return ends.groupBy(*keys).agg(*[F.max(F.when(c("_name") == n, value)).alias(n) for n in wanted])

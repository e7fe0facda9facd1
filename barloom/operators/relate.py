"""As-of, interval and offset joins written as bucketed equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: Sequence[str], keys: Sequence[str] = ("symbol",),
         strict: bool = False, span_seconds: int = 4096 * 3600, right_tie: str | None = None) -> DataFrame:
    """Latest right row with ``right_ts <= left_ts`` (``<`` when strict) per key.

    Both sides are interleaved by time; each time chunk is scanned on its own and takes the last right row of earlier chunks from a
    one-row-per-chunk summary, so one hot key is spread over its chunks.
    """
    keys = list(keys)
    side = "_side"
    packed = F.struct(*[F.col(v) for v in values]).alias("_payload")
    rank = F.lit(1 if strict else 0)
    l = left.select(*keys, F.unix_micros(left_ts).alias("_t"), F.lit(0 if strict else 1).alias(side), F.struct("*").alias("_row"))
    tie = [F.col(right_tie).cast("long").alias("_tie")] if right_tie else [F.lit(0).cast("long").alias("_tie")]
    r = right.select(*keys, F.unix_micros(right_ts).alias("_t"), rank.alias(side), packed, *tie)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("_t") / (span_seconds * 1_000_000)))
    present = F.col("_payload").isNotNull()
    ends = (r.withColumn("_chunk", F.floor(F.col("_t") / (span_seconds * 1_000_000))).groupBy(*keys, "_chunk")
            .agg(F.max_by("_payload", F.struct("_t", "_tie")).alias("_end")))
    # chunks that hold only left rows still need their carry
    chunks = both.select(*keys, "_chunk").distinct().join(ends, [*keys, "_chunk"], "left")
    back = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, "_chunk", F.last("_end", True).over(back).alias("_carry"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_t", side, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    scanned = both.withColumn("_last", F.last(F.when(present, F.col("_payload")), True).over(w)).filter(F.col("_row").isNotNull())
    out = scanned.join(carry, [*keys, "_chunk"], "left").withColumn("_hit", F.coalesce("_last", "_carry"))
    return out.select("_row.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def path(events: DataFrame, bars: DataFrame, first: Column, last: Column, values: Sequence[str], keys: Sequence[str] = ("symbol",),
         idx: str = "bar_idx") -> DataFrame:
    """Each event with every bar whose position lies in ``[first, last]`` (``step`` counts from 0); a bounded equi-join expansion."""
    want = events.withColumns({"_lo": first.cast("long"), "_hi": last.cast("long")}).filter("_lo <= _hi")
    long = want.select("*", F.posexplode(F.sequence("_lo", "_hi")).alias("step", "path_idx")).drop("_lo", "_hi")
    b = bars.select(*keys, F.col(idx).alias("path_idx"), *[F.col(v).alias(f"p_{v}") for v in values])
    return long.join(b, [*keys, "path_idx"])


def within(left: DataFrame, right: DataFrame, left_ts: str, right_lo: str, right_hi: str, bucket_seconds: int, keys: Sequence[str] = ("symbol",),
           how: str = "inner") -> DataFrame:
    """Rows of ``left`` whose time lies in ``[right_lo, right_hi]``; intervals are exploded into time buckets first."""
    keys = list(keys)
    b = bucket_seconds
    r = right.withColumn("_bucket", F.explode(F.sequence(F.floor(F.unix_timestamp(right_lo) / b), F.floor(F.unix_timestamp(right_hi) / b))))
    l = left.withColumn("_bucket", F.floor(F.unix_timestamp(left_ts) / b))
    cond = (F.col(left_ts) >= F.col(right_lo)) & (F.col(left_ts) <= F.col(right_hi))
    if how == "inner":
        return l.join(r, [*keys, "_bucket"]).filter(cond).drop("_bucket")
    eq = [l[k] == r[k] for k in [*keys, "_bucket"]]
    on = (l[left_ts] >= r[right_lo]) & (l[left_ts] <= r[right_hi])
    for e in eq:
        on = on & e
    return l.join(r, on, how).drop("_bucket")

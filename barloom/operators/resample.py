"""Bars to coarser bars: complete buckets, calendar closes, provenance, gaps and higher-timeframe context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.functions.cols import c
from barloom.operators.relate import asof



def ohlcv() -> list[Column]:
    return [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")]


def by_time(bars: DataFrame, seconds: int) -> DataFrame:
    """Left-labelled buckets; empty ones do not appear."""
    return bars.groupBy("symbol", clock.floor_to("ts", seconds).alias("bucket")).agg(*ohlcv(), F.count(F.lit(1)).alias("n"))


def complete(bars: DataFrame, seconds: int, source_seconds: int) -> DataFrame:
    """Only buckets holding every expected, on-grid, unique, finite source bar; ``close_ts`` is when the bucket is known."""
    expected = seconds // source_seconds
    start = F.unix_timestamp("ts")
    ok = (start % source_seconds == 0)
    for x in ("open", "high", "low", "close", "volume"):
        ok = ok & c(x).isNotNull() & ~F.isnan(x)
    out = (bars.withColumn("bucket", clock.floor_to("ts", seconds)).groupBy("symbol", "bucket")
           .agg(*ohlcv(), F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("slots"), F.min("ts").alias("first"), F.max("ts").alias("last"),
                F.bool_and(ok).alias("valid")))
    full = ((c("n") == expected) & (c("slots") == expected) & c("valid") & (c("first") == c("bucket"))
            & (F.unix_timestamp("last") == F.unix_timestamp("bucket") + seconds - source_seconds))
    return out.filter(full).withColumn("close_ts", F.timestamp_seconds(F.unix_timestamp("bucket") + seconds)).drop("slots", "first", "last", "valid")


def by_close(bars: DataFrame, label: Column) -> DataFrame:
    """Grouped by a calendar close label (market day or week)."""
    return bars.groupBy("symbol", label.alias("close_ts")).agg(*ohlcv(), F.count(F.lit(1)).alias("n"))


def with_provenance(bars: DataFrame, seconds: int, source_seconds: int, is_open: Column) -> DataFrame:
    """Roll-up carrying completeness (true / false / unknown), feed, observation times and the list of source bars."""
    b = bars.withColumn("bucket", clock.floor_to("ts", seconds))
    rolled = b.groupBy("symbol", "bucket").agg(
        *ohlcv(), F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("slots"), F.bool_or(~c("is_complete")).alias("any_partial"),
        F.bool_and(F.coalesce("is_complete", F.lit(False))).alias("all_complete"), F.count_distinct("feed_type").alias("feeds"),
        F.min("feed_type").alias("one_feed"), F.max("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"),
        F.bool_or(c("observation_kind").isin("backfill", "historical", "repair", "replay")).alias("any_backfill"),
        F.bool_and(c("observation_kind") == "live").alias("all_live"),
        F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("source_bars"))
    step = F.expr(f"INTERVAL {source_seconds} SECONDS")
    slots = F.transform(F.sequence("bucket", F.timestamp_seconds(F.unix_timestamp("bucket") + seconds - source_seconds), step), lambda t: t)
    spine = (rolled.select("symbol", "bucket", F.explode(slots).alias("ts")).filter(is_open).groupBy("symbol", "bucket")
             .agg(F.count(F.lit(1)).alias("expected")))
    out = rolled.join(spine, ["symbol", "bucket"], "left")
    covered = (F.coalesce("expected", F.lit(0)) > 0) & (c("expected") == c("slots")) & (c("slots") == c("n"))
    return out.withColumns({
        "covered": F.coalesce(covered, F.lit(False)),
        "is_complete": F.when(~F.coalesce(covered, F.lit(False)) | F.coalesce("any_partial", F.lit(False)), F.lit(False)).when(c("all_complete"), F.lit(True)),
        "feed_type": F.when(c("feeds") == 1, c("one_feed")).otherwise("mixed"),
        "observation_kind": F.when(c("any_backfill"), "backfill").when(c("all_live"), "live").otherwise("unknown")})


def gaps(bars: DataFrame, seconds: int, is_open, span_seconds: int = 4096 * 3600) -> DataFrame:
    """Missing expected slots before each bar, listed; one row per bar that follows a gap."""
    prev = Window.partitionBy("symbol", "_c").orderBy("ts")
    b = bars.withColumn("_c", F.floor(F.unix_timestamp("ts") / span_seconds))
    ends = b.groupBy("symbol", "_c").agg(F.max("ts").alias("_e"))
    back = ends.select("symbol", "_c", F.lag("_e").over(Window.partitionBy("symbol").orderBy("_c")).alias("_p"))
    d = b.join(back, ["symbol", "_c"]).withColumn("prev_ts", F.coalesce(F.lag("ts").over(prev), "_p"))
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    wide = d.filter(F.unix_timestamp("ts") - F.unix_timestamp("prev_ts") > seconds)
    slot = wide.select("symbol", "ts", "prev_ts", F.explode(F.sequence(c("prev_ts") + step, c("ts") - step, step)).alias("slot"))
    kept = slot.filter(is_open("slot"))
    return kept.groupBy("symbol", "ts", "prev_ts").agg(F.min("slot").alias("expected_ts"), F.count(F.lit(1)).alias("gap_size"),
                                                       F.array_sort(F.collect_list("slot")).alias("missing"))


def align(bars: DataFrame, coarse: DataFrame, values, decision_seconds: int) -> DataFrame:
    """Latest coarse row closed by the time the base bar itself is known."""
    b = bars.withColumn("decision_ts", F.timestamp_seconds(F.unix_timestamp("ts") + decision_seconds))
    return asof(b, coarse, "decision_ts", "close_ts", values)


def prior_period(bars: DataFrame, period: Column, values: dict[str, Column]) -> DataFrame:
    """Value of the latest period strictly before the row's own (one row per symbol and period carries it)."""
    b = bars.withColumn("_p", period)
    per = b.groupBy("symbol", "_p").agg(*[v.alias(k) for k, v in values.items()])
    w = Window.partitionBy("symbol").orderBy("_p")
    prev = per.select("symbol", "_p", *[F.lag(k).over(w).alias(k) for k in values])
    return b.join(prev, ["symbol", "_p"], "left").drop("_p")

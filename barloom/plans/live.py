"""SM05, SM06 and SM09 over file streams that grow batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators import features as ff
from barloom.operators.blocks import blocked
from barloom.plans.registry import query, shared
from barloom.sources.files import scratch
from barloom.streaming import live

KEY = "symbol:s bar_idx:l "
STALE, LATE = 3600, 7200  #: seconds without a tick; lateness that the watermark allows
BATCHES = 4


@query("sm05_heartbeats", "symbol:s status:s at_ts:t last_beat:t", f"""WITH t AS (SELECT DISTINCT symbol, date_trunc('second', ts) AS ts FROM ticks), g AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM t)
 SELECT symbol, 'stale' AS status, ts + INTERVAL {STALE} SECOND AS at_ts, ts AS last_beat FROM g WHERE nxt > ts + INTERVAL {STALE} SECOND OR (nxt IS NULL AND ts + INTERVAL {STALE} SECOND < (SELECT max(ts) FROM t) - INTERVAL {LATE} SECOND)
 UNION ALL SELECT symbol, 'recovered', ts, prev FROM g WHERE ts > prev + INTERVAL {STALE} SECOND""")
def _(m):
    ticks = m.ticks.select("symbol", F.date_trunc("second", "ts").alias("ts")).distinct()
    ends = ticks.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    part = F.least(F.floor((F.unix_timestamp("ts") - F.lit(ends.a.timestamp())) / F.lit(max(1.0, (ends.z.timestamp() - ends.a.timestamp()) / BATCHES))), F.lit(BATCHES - 1))
    feed, out = live.Feed(m.spark, ticks.schema, "beats"), scratch(m.spark, "heartbeats")
    for k in range(BATCHES):
        feed.push(ticks.filter(part == k), lambda s: live.into_table(live.heartbeats(s.withWatermark("ts", f"{LATE} seconds"), STALE), out, feed.checkpoint))
    return m.spark.read.schema(live.BEATS).parquet(out)


def _values(d):
    return blocked(d, lambda d, w: ff.structure(ff.volatility(d, w), w), before=122).select("symbol", "bar_idx", "atr_14", "atr_50", "prior_high_20", "prior_low_50", "sweep_high_20", "sweep_low_20", "price_position_50")


VALUES = "atr_14 atr_50 prior_high_20 prior_low_50 sweep_high_20:l sweep_low_20:l price_position_50"


@query("sm06_rolling_features", KEY + VALUES, "SELECT * FROM struc")
def _(m):
    bars = m.bars()
    feed, kept = live.Feed(m.spark, bars.schema, "new-bars"), live.RollingFeatures(m.spark, _values, 122)
    last = bars.agg(F.max("bar_idx")).first()[0]
    for k in range(BATCHES):
        feed.push(bars.filter((c("bar_idx") * BATCHES / (last + 1)).cast("int") == k), lambda s: live.for_each(s, kept.work, feed.checkpoint))
    return kept.result()


_FIX = "bar_idx % 97 = 5 OR bar_idx % 131 = 40"
shared("fixed_bars", f"SELECT * REPLACE (CASE WHEN {_FIX} THEN close + 25 ELSE close END AS close, CASE WHEN {_FIX} THEN greatest(high, close + 25) ELSE high END AS high) FROM bars")


def _fixed_sql():
    from barloom.plans.families import struct_sql
    from barloom.plans.registry import SHARED
    for name in ("pa", "vol"):
        shared(f"fx_{name}", SHARED[name].replace("FROM bars", "FROM fixed_bars").replace("FROM pa", "FROM fx_pa"))
    return struct_sql("fx_vol")


@query("sm09_revisions", KEY + VALUES, f"SELECT * FROM ({_fixed_sql()})")
def _(m):
    """Corrections arrive in four batches that are out of order in time, some of them twice; an early version comes last and is ignored."""
    bars = m.bars()
    book = live.Revisions(m.spark, bars, _values, 122)
    wrong = bars.filter(_FIX).withColumns({"close": c("close") + 25, "high": F.greatest("high", c("close") + 25), "version": F.lit(2).cast("long")})
    feed = live.Feed(m.spark, wrong.schema, "corrections")
    early = wrong.filter("bar_idx % 2 = 0").withColumns({"close": c("close") - 3, "version": F.lit(1).cast("long")})
    for rows in (wrong.filter("bar_idx % 3 = 1"), wrong.filter("bar_idx % 3 = 0"), wrong.filter("bar_idx % 3 >= 1"), early):
        feed.push(rows, lambda s: live.for_each(s, book.work, feed.checkpoint))
    book.resume()
    return book.latest()

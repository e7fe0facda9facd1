"""Zigzag swings, trend pullbacks and breakouts after compression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators.blocks import BLOCK_ROWS, blocked, carry_last, chained

INIT, LEAST_AFTER = 50, 10  #: bars that set the first direction; bars that must follow the first usable one


def _zigzag(confirm: float, least_size: float, least_distance: float, apart: int):
    """Walks one block. State: direction, candidate high (price, bar, atr), candidate low (price, bar, atr), last swing's price and bar."""
    def run(p, state):
        d, ch, chi, cha, cl, cli, cla, last, last_i = state
        n = len(p)
        out = {k: np.full(n, np.nan) for k in ("swing_side", "swing_idx", "swing_price", "swing_atr", "swing_size_atr")}
        cols = (p[x].to_numpy(float) for x in ("bar_idx", "high", "low", "close", "atr_14", "_scan", "_dir", "_hi", "_hii", "_hia", "_lo", "_loi", "_loa"))
        for k, (i, high, low, close, a, scan, d0, hi, hii, hia, lo, loi, loa) in enumerate(zip(*cols)):
            if not i >= scan:  # also where the history is too short
                continue
            if d == 0:
                d, ch, chi, cha, cl, cli, cla, last, last_i = d0, hi, hii, hia, lo, loi, loa, hi if d0 < 0 else lo, -apart - 1
            if not a > 0:
                continue
            if d > 0 and high > ch:
                ch, chi, cha = high, i, a
            elif d < 0 and low < cl:
                cl, cli, cla = low, i, a
            price, at, atr = (ch, chi, cha) if d > 0 else (cl, cli, cla)
            if (price - close) * d < confirm * a or i <= at:
                continue
            far = abs(price - last)
            size = far / (atr if atr > 0 else a)
            if at - last_i >= apart and far >= least_distance * a and size >= least_size:
                for name, v in zip(out, (-d, at, price, atr if atr > 0 else a, size)):
                    out[name][k] = v
                last, last_i = price, at
            d = -d
            if d > 0:
                ch, chi, cha = high, i, a
            else:
                cl, cli, cla = low, i, a
        return out, [d, ch, chi, cha, cl, cli, cla, last, last_i]

    return run


def zigzag(bars: DataFrame, warmup: int = 60, confirm: float = 1.5, least_size: float = 1.5, least_distance: float = 1.0, apart: int = 3, size: int = BLOCK_ROWS) -> DataFrame:
    """(symbol, confirm_idx, swing_side, swing_idx, swing_price, swing_atr, swing_size_atr): swings confirmed by a close that retraces ``confirm`` ATR.

    A provisional pivot is replaced by every further extreme until it is confirmed. A swing closer than ``apart`` bars or ``least_distance`` ATR to the
    one before, or smaller than ``least_size`` ATR, turns the direction but is not a swing. Side is 1 for a low. The walk runs through the whole
    history; ``bars`` holds atr_14.
    """
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when((c("bar_idx") >= warmup) & (c("atr_14") > 0), c("bar_idx"))).alias("_start"))
    n = n.filter((c("_n") >= warmup + 20) & (c("_start") < c("_n") - LEAST_AFTER))  # one row a symbol
    first = bars.join(n, "symbol").filter((c("bar_idx") >= c("_start")) & (c("bar_idx") < c("_start") + INIT))
    pick = lambda x, sign: F.max_by(F.struct(c(x).alias("px"), c("bar_idx").alias("i"), c("atr_14").alias("a")), F.struct(sign * c(x), -c("bar_idx")))
    first = first.groupBy("symbol").agg(pick("high", 1).alias("h"), pick("low", -1).alias("l"))
    start = first.select("symbol", (F.greatest("h.i", "l.i") + 1).alias("_scan"), F.when(c("h.i") < c("l.i"), -1).otherwise(1).alias("_dir"), c("h.px").alias("_hi"), c("h.i").alias("_hii"), c("h.a").alias("_hia"),
                         c("l.px").alias("_lo"), c("l.i").alias("_loi"), c("l.a").alias("_loa"))
    d = bars.select("symbol", "bar_idx", "high", "low", "close", "atr_14").join(start, "symbol")
    inputs = [x for x in d.columns if x not in ("symbol", "bar_idx")]
    walk = chained(d, _zigzag(confirm, least_size, least_distance, apart), [0.0] + [float("nan")] * 8, "swing_side double, swing_idx double, swing_price double, swing_atr double, swing_size_atr double", inputs, size)
    whole = {k: c(k).cast("long") for k in ("swing_side", "swing_idx")}
    return walk.filter(c("swing_side").isNotNull() & ~F.isnan("swing_side")).withColumns(whole).withColumnRenamed("bar_idx", "confirm_idx")


def pullbacks(swings: DataFrame, bars: DataFrame, trend: DataFrame, least: float = 0.5, most: float = 8.0, most_bars: int = 80, floor: float = 0.5, most_break: float = 1.5, least_bounce: float = 0.3) -> DataFrame:
    """Swings that are pullbacks of a trend: depth from the opposite swing before, length, distance from the slow average, break of the swing before of
    the same side and bounce at the confirming close, all in ATR of the swing's bar. ``trend``: symbol, bar_idx, trend (1, -1, 0), slow."""
    s = carry_last(swings, {f"_{k}_{x}": F.when(c("swing_side") == v, c(f"swing_{x}")) for k, v in (("lo", 1), ("hi", -1)) for x in ("price", "idx")}, order="swing_idx", strict=True)
    low = c("swing_side") == 1
    s = s.withColumns({"anchor_price": F.when(low, c("_hi_price")).otherwise(c("_lo_price")), "anchor_idx": F.when(low, c("_hi_idx")).otherwise(c("_lo_idx")), "_same": F.when(low, c("_lo_price")).otherwise(c("_hi_price"))})
    s = s.join(trend.select("symbol", c("bar_idx").alias("swing_idx"), "trend", "slow"), ["symbol", "swing_idx"])
    s = s.join(bars.select("symbol", c("bar_idx").alias("confirm_idx"), c("close").alias("_confirm")), ["symbol", "confirm_idx"])
    side, px, a = c("swing_side"), c("swing_price"), c("swing_atr")
    s = s.withColumns({"pullback_depth_atr": (c("anchor_price") - px) * side / a, "pullback_bars": c("swing_idx") - c("anchor_idx"), "floor_atr": (px - c("slow")) * side / a,
                       "break_atr": F.greatest(F.coalesce((c("_same") - px) * side / a, F.lit(0.0)), F.lit(0.0)), "bounce_atr": (c("_confirm") - px) * side / a})
    return s.filter((c("trend") == side) & c("pullback_depth_atr").between(least, most) & (c("pullback_bars") <= most_bars) & (c("floor_atr") >= -floor) & (c("break_atr") <= most_break) & (c("bounce_atr") >= least_bounce))


def breakouts(bars: DataFrame, trend: DataFrame, lookback: int = 20, compression: int = 10, warmup: int = 60, least_range: float = 1.0, most_compression: float = 5.0, buffer: float = 0.05, most_extension: float = 2.0,
              least_body: float = 0.4, least_location: float = 0.6) -> DataFrame:
    """Closes beyond the range of the ``lookback`` bars before, after a compressed stretch and along the trend. ``bars`` holds atr_14."""
    def build(d, w):
        rng = F.when(c("high") != c("low"), c("high") - c("low"))
        return d.withColumns({"range_high": w.max("high", lookback, 1), "range_low": w.min("low", lookback, 1), "_ch": w.max("high", compression, 1), "_cl": w.min("low", compression, 1), "_pc": F.coalesce(w.lag("close"), c("close")),
                              "body_fraction": F.coalesce(F.abs(c("close") - c("open")) / rng, F.lit(0.0)), "_ll": F.coalesce((c("close") - c("low")) / rng, F.lit(0.0)), "_ls": F.coalesce((c("high") - c("close")) / rng, F.lit(0.0))})
    d = blocked(bars, build, before=max(lookback, compression) + 1).join(trend.select("symbol", "bar_idx", "trend"), ["symbol", "bar_idx"])
    d = d.filter((c("bar_idx") >= warmup) & (c("atr_14") > 0)).withColumns({"range_width_atr": (c("range_high") - c("range_low")) / c("atr_14"), "compression_atr": (c("_ch") - c("_cl")) / c("atr_14")})
    d = d.filter((c("range_width_atr") >= least_range) & (c("compression_atr") <= most_compression) & (c("body_fraction") >= least_body))
    up, down = (c("close") - c("range_high")) / c("atr_14"), (c("range_low") - c("close")) / c("atr_14")
    edge = buffer * c("atr_14")
    long = (c("trend") == 1) & (c("_pc") <= c("range_high") + edge) & (c("high") >= c("range_high")) & (c("close") >= c("range_high") + edge) & (up <= most_extension) & (c("_ll") >= least_location)
    short = (c("trend") == -1) & (c("_pc") >= c("range_low") - edge) & (c("low") <= c("range_low")) & (c("close") <= c("range_low") - edge) & (down <= most_extension) & (c("_ls") >= least_location)
    d = d.withColumn("side", F.when(long, 1).when(short, -1)).filter("side IS NOT NULL")
    return d.withColumns({"level": F.when(c("side") == 1, c("range_high")).otherwise(c("range_low")), "extension_atr": F.when(c("side") == 1, up).otherwise(down)}).drop("_ch", "_cl", "_pc", "_ll", "_ls")

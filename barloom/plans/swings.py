"""DT15-DT17 on zigzag swings, and the label builds LB14 on top of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c, sign3
from barloom.operators import features as ff
from barloom.operators import labels as lb
from barloom.operators import resample
from barloom.operators import swings as sw
from barloom.operators.blocks import blocked, number_rows
from barloom.operators.relate import asof
from barloom.plans.policy import ema
from barloom.plans.registry import query, s_div, s_lag, s_last, s_max, s_mean, s_min, shared
from barloom.plans.trade import LBOUT, touch_sql

KEY = "symbol:s "
LEAST_SPREAD = 0.1  #: of the higher bars' ATR


def _vol(m):
    return m.stage("vol_bars", lambda: blocked(m.bars(), ff.volatility, before=61).select("symbol", "bar_idx", "ts", "open", "high", "low", "close", "atr_14"))


def trend_t(m):
    """Trend of the last complete four hours at each bar."""
    def build():
        h4 = m.stage("h4", lambda: number_rows(resample.complete(m.bars(), 14400, 3600).withColumnRenamed("bucket", "ts"), span_seconds=4096 * 14400))
        h = blocked(ff.with_smooth(h4, weeks=104), ff.volatility, before=61)
        spread = (c("ema_8") - c("ema_21")) / F.when(c("atr_14") != 0, c("atr_14"))
        h = h.withColumns({"trend": sign3(spread >= LEAST_SPREAD, -spread >= LEAST_SPREAD), "slow": c("ema_21"), "trend_spread_atr": spread})
        b = m.bars().withColumn("decision_ts", F.timestamp_seconds(F.unix_timestamp("ts") + 3600)).select("symbol", "bar_idx", "decision_ts")
        d = asof(b, h, "decision_ts", "close_ts", ["trend", "slow", "trend_spread_atr"])
        return d.withColumn("trend", F.coalesce("trend", F.lit(0)))
    return m.stage("trend4", build)


_TR4 = f"greatest(high - low, abs(high - {s_lag('close')}), abs(low - {s_lag('close')}))"
shared("trend4", f"""SELECT b.symbol, b.bar_idx, coalesce(h.trend, 0) AS trend, h.e21 AS slow, h.spread AS trend_spread_atr FROM (SELECT *, ts + INTERVAL 1 HOUR AS dts FROM bars) b ASOF LEFT JOIN (
 SELECT *, CASE WHEN spread >= {LEAST_SPREAD} THEN 1 WHEN -spread >= {LEAST_SPREAD} THEN -1 ELSE 0 END AS trend FROM (SELECT *, {s_div('e8 - e21', 'a14')} AS spread FROM (SELECT *, {s_mean('tr', 14)} AS a14 FROM (
 SELECT *, {_TR4} AS tr, {ema('close', 8)} AS e8, {ema('close', 21)} AS e21 FROM h4x)))) h ON h.symbol = b.symbol AND b.dts >= h.close_ts""")


def swings_t(m):
    return m.stage("zigzag", lambda: sw.zigzag(_vol(m)))


# ---- the twin walks the bars one by one ---------------------------------------------------------------------------------------
ZIG = """WITH RECURSIVE v AS MATERIALIZED (SELECT symbol, bar_idx, high, low, close, atr_14 AS a FROM vol),
 s0 AS (SELECT symbol, count(*) AS n, min(bar_idx) FILTER (bar_idx >= 60 AND a > 0) AS st FROM v GROUP BY 1),
 s1 AS (SELECT v.symbol, arg_max({'p': high, 'i': bar_idx, 'a': a}, (high, -bar_idx)) AS h, arg_max({'p': low, 'i': bar_idx, 'a': a}, (-low, -bar_idx)) AS l FROM v JOIN s0 ON s0.symbol = v.symbol
  WHERE n >= 80 AND st < n - 10 AND bar_idx >= st AND bar_idx < st + 50 GROUP BY 1),
 z AS (SELECT symbol, greatest(h.i, l.i) AS i, CASE WHEN h.i < l.i THEN -1 ELSE 1 END AS d, h.p AS ch, h.i AS chi, h.a AS cha, l.p AS cl, l.i AS cli, l.a AS cla, CASE WHEN h.i < l.i THEN h.p ELSE l.p END AS last, CAST(-4 AS BIGINT) AS last_i,
  0 AS side, CAST(NULL AS BIGINT) AS pat, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS size FROM s1
 UNION ALL SELECT symbol, i, CASE WHEN turn THEN -d ELSE d END, CASE WHEN turn AND d = -1 THEN high ELSE ch END, CASE WHEN turn AND d = -1 THEN i ELSE chi END, CASE WHEN turn AND d = -1 THEN a ELSE cha END,
  CASE WHEN turn AND d = 1 THEN low ELSE cl END, CASE WHEN turn AND d = 1 THEN i ELSE cli END, CASE WHEN turn AND d = 1 THEN a ELSE cla END, CASE WHEN hit THEN p ELSE last END, CASE WHEN hit THEN pi ELSE last_i END,
  CASE WHEN hit THEN -d ELSE 0 END, pi, p, pa, abs(p - last) / pa FROM (
  SELECT *, turn AND pi - last_i >= 3 AND abs(p - last) >= 1.0 * a AND abs(p - last) / pa >= 1.5 AS hit FROM (
  SELECT *, coalesce(a > 0 AND (p - close) * d >= 1.5 * a AND i > pi, false) AS turn FROM (
  SELECT *, CASE WHEN d = 1 THEN ch ELSE cl END AS p, CASE WHEN d = 1 THEN chi ELSE cli END AS pi, CASE WHEN d = 1 THEN CASE WHEN cha > 0 THEN cha ELSE a END ELSE CASE WHEN cla > 0 THEN cla ELSE a END END AS pa FROM (
  SELECT v.symbol, v.bar_idx AS i, v.high, v.low, v.close, v.a, z.d, z.last, z.last_i, CASE WHEN z.d = 1 AND v.a > 0 AND v.high > z.ch THEN v.high ELSE z.ch END AS ch, CASE WHEN z.d = 1 AND v.a > 0 AND v.high > z.ch THEN v.bar_idx ELSE z.chi END AS chi,
  CASE WHEN z.d = 1 AND v.a > 0 AND v.high > z.ch THEN v.a ELSE z.cha END AS cha, CASE WHEN z.d = -1 AND v.a > 0 AND v.low < z.cl THEN v.low ELSE z.cl END AS cl, CASE WHEN z.d = -1 AND v.a > 0 AND v.low < z.cl THEN v.bar_idx ELSE z.cli END AS cli,
  CASE WHEN z.d = -1 AND v.a > 0 AND v.low < z.cl THEN v.a ELSE z.cla END AS cla FROM z JOIN v ON v.symbol = z.symbol AND v.bar_idx = z.i + 1)))))
 SELECT symbol, i AS confirm_idx, side AS swing_side, pat AS swing_idx, price AS swing_price, atr AS swing_atr, size AS swing_size_atr FROM z WHERE side <> 0"""
_ZO = "PARTITION BY symbol ORDER BY swing_idx"
PULL = f"""SELECT * FROM (SELECT s.*, t.trend, (anchor_price - swing_price) * swing_side / swing_atr AS pullback_depth_atr, s.swing_idx - anchor_idx AS pullback_bars, (swing_price - t.slow) * swing_side / swing_atr AS floor_atr,
 greatest(coalesce((same - swing_price) * swing_side / swing_atr, 0), 0) AS break_atr, (k.close - swing_price) * swing_side / swing_atr AS bounce_atr FROM (
 SELECT *, CASE WHEN swing_side = 1 THEN hp ELSE lp END AS anchor_price, CASE WHEN swing_side = 1 THEN hi ELSE li END AS anchor_idx, CASE WHEN swing_side = 1 THEN lp ELSE hp END AS same FROM (
 SELECT *, {', '.join(f"{s_last(f'CASE WHEN swing_side = {v} THEN swing_{x} END', _ZO, True)} AS {n}" for v, x, n in ((1, 'price', 'lp'), (1, 'idx', 'li'), (-1, 'price', 'hp'), (-1, 'idx', 'hi')))} FROM ({ZIG}))) s
 JOIN trend4 t ON t.symbol = s.symbol AND t.bar_idx = s.swing_idx JOIN bars k ON k.symbol = s.symbol AND k.bar_idx = s.confirm_idx)
 WHERE trend = swing_side AND pullback_depth_atr BETWEEN 0.5 AND 8 AND pullback_bars <= 80 AND floor_atr >= -3 AND break_atr <= 3 AND bounce_atr >= 0.3"""
_B = "CASE WHEN high <> low THEN high - low END"
BRK = f"""SELECT *, CASE WHEN side = 1 THEN range_high ELSE range_low END AS level, CASE WHEN side = 1 THEN ext_u ELSE ext_d END AS extension_atr FROM (SELECT *, CASE WHEN trend = 1 AND pc <= range_high + 0.05 * a AND high >= range_high AND close >= range_high + 0.05 * a AND ext_u <= 2 AND ll >= 0.6 THEN 1
 WHEN trend = -1 AND pc >= range_low - 0.05 * a AND low <= range_low AND close <= range_low - 0.05 * a AND ext_d <= 2 AND ls >= 0.6 THEN -1 END AS side FROM (SELECT *, (range_high - range_low) / a AS range_width_atr, (ch - cl) / a AS compression_atr, (close - range_high) / a AS ext_u, (range_low - close) / a AS ext_d FROM (
 SELECT v.symbol, v.bar_idx, v.ts, v.open, v.high, v.low, v.close, v.atr_14 AS a, t.trend, t.trend_spread_atr, {s_max('v.high', 20, 1, 'PARTITION BY v.symbol ORDER BY v.bar_idx')} AS range_high, {s_min('v.low', 20, 1, 'PARTITION BY v.symbol ORDER BY v.bar_idx')} AS range_low,
 {s_max('v.high', 10, 1, 'PARTITION BY v.symbol ORDER BY v.bar_idx')} AS ch, {s_min('v.low', 10, 1, 'PARTITION BY v.symbol ORDER BY v.bar_idx')} AS cl, coalesce({s_lag('v.close', 1, 'PARTITION BY v.symbol ORDER BY v.bar_idx')}, v.close) AS pc,
 coalesce(abs(v.close - v.open) / ({_B.replace('high', 'v.high').replace('low', 'v.low')}), 0) AS body_fraction, coalesce((v.close - v.low) / ({_B.replace('high', 'v.high').replace('low', 'v.low')}), 0) AS ll, coalesce((v.high - v.close) / ({_B.replace('high', 'v.high').replace('low', 'v.low')}), 0) AS ls
 FROM vol v JOIN trend4 t ON t.symbol = v.symbol AND t.bar_idx = v.bar_idx)) WHERE bar_idx >= 60 AND a > 0 AND range_width_atr >= 1 AND compression_atr <= 5 AND body_fraction >= 0.4) WHERE side IS NOT NULL"""
SPACED = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY bar_idx) AS rn FROM ({BRK})),
 r AS (SELECT symbol, side, rn, bar_idx AS kept, 1 AS accepted FROM e WHERE rn = 1 UNION ALL SELECT e.symbol, e.side, e.rn, CASE WHEN e.bar_idx - r.kept >= 6 THEN e.bar_idx ELSE r.kept END, CASE WHEN e.bar_idx - r.kept >= 6 THEN 1 ELSE 0 END
 FROM r JOIN e ON e.symbol = r.symbol AND e.side = r.side AND e.rn = r.rn + 1) SELECT e.* FROM e JOIN r ON r.symbol = e.symbol AND r.side = e.side AND r.rn = e.rn WHERE r.accepted = 1"""


@query("dt15_zigzag_swings", KEY + "confirm_idx:l swing_side:l swing_idx:l swing_price swing_atr swing_size_atr", ZIG)
def _(m):
    return swings_t(m)


def pullbacks_t(m):
    return m.stage("pullbacks", lambda: sw.pullbacks(swings_t(m), m.bars(), trend_t(m), floor=3.0, most_break=3.0))


@query("dt17_trend_pullbacks", KEY + "confirm_idx:l swing_side:l swing_idx:l anchor_idx:l pullback_depth_atr pullback_bars:l floor_atr break_atr bounce_atr", PULL)
def _(m):
    return pullbacks_t(m)


def breakouts_t(m):
    return m.stage("breakouts", lambda: lb.cooldown(sw.breakouts(_vol(m), trend_t(m)), 5, ("symbol", "side")).filter("accepted = 1").drop("accepted"))


@query("dt16_compression_breakouts", KEY + "bar_idx:l side:l level range_width_atr compression_atr body_fraction extension_atr", SPACED)
def _(m):
    return breakouts_t(m)


# ---- label builds: every event source runs through the same barriers ----------------------------------------------------------
_SRC = {"reversal": f"SELECT s.symbol, s.confirm_idx AS bar_idx, s.swing_side AS side, k.close, s.swing_atr AS atr FROM ({ZIG}) s JOIN bars k ON k.symbol = s.symbol AND k.bar_idx = s.confirm_idx",
        "pullback": f"SELECT s.symbol, s.confirm_idx AS bar_idx, s.swing_side AS side, k.close, s.swing_atr AS atr FROM ({PULL}) s JOIN bars k ON k.symbol = s.symbol AND k.bar_idx = s.confirm_idx",
        "breakout": f"SELECT symbol, bar_idx, side, close, a AS atr FROM ({SPACED})"}


def _sources(m):
    at = m.bars().select("symbol", c("bar_idx").alias("confirm_idx"), "close")
    swing = lambda d: d.join(at, ["symbol", "confirm_idx"]).select("symbol", c("confirm_idx").alias("bar_idx"), c("swing_side").alias("side"), "close", c("swing_atr").alias("atr"))
    return {"reversal": lambda: swing(swings_t(m)), "pullback": lambda: swing(pullbacks_t(m)), "breakout": lambda: breakouts_t(m).select("symbol", "bar_idx", "side", "close", c("atr_14").alias("atr"))}


for _n in _SRC:
    query(f"lb14_{_n}_labels", LBOUT, touch_sql(_SRC[_n], "close", "close + side * 2 * atr", "close - side * atr", "e.bar_idx + 1", 24))(
        lambda m, n=_n: lb.first_touch(_sources(m)[n](), m.bars(), c("close"), c("close") + c("side") * 2 * c("atr"), c("close") - c("side") * c("atr"), c("bar_idx") + 1, 24))

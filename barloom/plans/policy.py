"""Outcomes, admission, costs, policies, regimes and the composed feature build."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.functions.cols import c, flag, safe_div, sign3
from barloom.operators import features as ff
from barloom.operators import labels as lb
from barloom.operators import metrics as mt
from barloom.operators import outcomes as oc
from barloom.operators import resample
from barloom.operators.blocks import blocked, carry_last, chained, kernel, number_rows, week_anchor, weekly_spread, with_kernel
from barloom.operators.recursive import cusum
from barloom.operators.relate import asof
from barloom.operators.select import spine
from barloom.plans import families as fam
from barloom.plans.base import NYSQL
from barloom.plans.registry import (S, query, s_div, s_flag, s_lag, s_last, s_max, s_mean, s_min, s_since, s_std, shared)
from barloom.plans.trade import SUMOUT, SUMSQL, events, labelled, predictions, trades

KEY = "symbol:s bar_idx:l "

# ---- composed build ---------------------------------------------------------------------------------------------------------
FULL = ["close_return_1", "atr_14", "rolling_vol_60", "ema_alignment", "macd_hist", "rsi_14", "price_position_50", "volume_zscore_50", "bars_since_sweep_high", "range_compression_10_50",
        "major_event_density_10", "hour_sin", "bullish_divergence_strength"]


def full_build(m):
    return m.stage("full", lambda: ff.core(m.bars(), (ff.exhaustion, ff.session, ff.temporal)))


@query("ff20_full_feature_build", KEY + " ".join(FULL), "SELECT symbol, bar_idx, " + ", ".join(f"coalesce({s_last(x)}, 0) AS {x}" for x in FULL) + " FROM tmp WHERE bar_idx >= 200")
def _(m):
    d = full_build(m).filter("bar_idx >= 200")
    d = carry_last(d.select("symbol", "bar_idx", *[c(x).cast("double").alias(x) for x in FULL]), {f"f_{x}": c(x) for x in FULL})
    return d.select("symbol", "bar_idx", *[F.coalesce(f"f_{x}", F.lit(0.0)).alias(x) for x in FULL])


@query("ff21_latest_snapshot", "symbol:s bar_idx:l atr_14 rsi_14 ema_alignment:l", "SELECT * FROM tmp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) = 1")
def _(m):
    from barloom.operators.provenance import latest
    return latest(full_build(m).select("symbol", "bar_idx", "atr_14", "rsi_14", "ema_alignment"))


INT = ["interaction_trend_momentum", "interaction_trend_rsi", "interaction_vol_adjusted_momentum", "interaction_london_momentum", "interaction_bull_reversal_context", "interaction_orderflow_return",
       "interaction_bull_structure_proximity", "interaction_bear_rejection_structure", "interaction_compression_bull_reversion", "interaction_london_bull_setup"]
_BP = fam.prox(s_div("close - latest_swing_low", "atr_14"))
_SP = fam.prox(s_div("latest_swing_high - close", "atr_14"))


def s_avg(*xs):
    return "list_avg(list_filter([" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "], lambda z: z IS NOT NULL))"


@query("ff15_interactions", KEY + " ".join(INT), f"""SELECT *, ema_alignment * roc_5 AS interaction_trend_momentum, ema_alignment * rsi_from_mid AS interaction_trend_rsi, {s_div('roc_5', 'atr_ratio_14_50')} AS interaction_vol_adjusted_momentum,
 in_london_session * roc_5 AS interaction_london_momentum, sweep_low_20 * (in_discount_zone + {s_flag('ema_alignment > 0')}) AS interaction_bull_reversal_context, volume_imbalance_10 * close_return_1 AS interaction_orderflow_return,
 bp AS interaction_bull_structure_proximity, sp * bearish_rejection AS interaction_bear_rejection_structure, compression_regime * {s_avg('bullish_divergence_strength', 'bull_volume_exhaustion', 'failed_breakout_bear', 'bp')} AS interaction_compression_bull_reversion,
 in_london_killzone * {s_avg('bp', 'bullish_rejection', '0')} AS interaction_london_bull_setup FROM (SELECT *, {_BP} AS bp, {_SP} AS sp FROM tmp)""")
def _(m):
    d = full_build(m).withColumns({"latest_low_dist_atr": safe_div(c("close") - c("latest_swing_low"), "atr_14"), "latest_high_dist_atr": safe_div(c("latest_swing_high") - c("close"), "atr_14")})
    return ff.interactions(d)


@query("wn34_event_order_sequences", KEY + "bull_sequence_sweep_displacement:l bear_sequence_sweep_displacement:l major_event_density_25", "SELECT * FROM tmp")
def _(m):
    return full_build(m)


HTF = "prev_day_high prev_day_low rolling_daily_high rolling_daily_low rolling_weekly_high rolling_weekly_low htf_ema_alignment:l htf_close"


def ema(x, n):
    return fam.ema(x, n)


shared("h4s", f"SELECT *, CASE WHEN e8 > e21 AND e21 > e50 THEN 1 WHEN e8 < e21 AND e21 < e50 THEN -1 ELSE 0 END AS al FROM (SELECT *, {ema('close', 8)} AS e8, {ema('close', 21)} AS e21, {ema('close', 50)} AS e50 FROM h4x)")
shared("d1r", "SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY close_ts ROWS 4 PRECEDING) AS rh, min(low) OVER (PARTITION BY symbol ORDER BY close_ts ROWS 4 PRECEDING) AS rl FROM d1")
shared("w1r", "SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY close_ts ROWS 3 PRECEDING) AS rh, min(low) OVER (PARTITION BY symbol ORDER BY close_ts ROWS 3 PRECEDING) AS rl FROM w1")


@query("ff11_htf_context", KEY + HTF, """SELECT b.symbol, b.bar_idx, d.high AS prev_day_high, d.low AS prev_day_low, d.rh AS rolling_daily_high, d.rl AS rolling_daily_low, w.rh AS rolling_weekly_high, w.rl AS rolling_weekly_low, h.al AS htf_ema_alignment, h.close AS htf_close
 FROM (SELECT *, ts + INTERVAL 1 HOUR AS dts FROM bars) b ASOF LEFT JOIN d1r d ON d.symbol = b.symbol AND b.dts >= d.close_ts ASOF LEFT JOIN w1r w ON w.symbol = b.symbol AND b.dts >= w.close_ts ASOF LEFT JOIN h4s h ON h.symbol = b.symbol AND b.dts >= h.close_ts""")
def _(m):
    from pyspark.sql import Window
    b = m.bars().withColumn("decision_ts", F.timestamp_seconds(F.unix_timestamp("ts") + 3600))
    roll = lambda n: Window.partitionBy("symbol").orderBy("close_ts").rowsBetween(-n, 0)
    day = resample.by_close(m.bars(), clock.day_close()).select("symbol", "close_ts", c("high").alias("prev_day_high"), c("low").alias("prev_day_low"),
                                                                F.max("high").over(roll(4)).alias("rolling_daily_high"), F.min("low").over(roll(4)).alias("rolling_daily_low"))
    week = resample.by_close(m.bars(), clock.week_close()).select("symbol", "close_ts", F.max("high").over(roll(3)).alias("rolling_weekly_high"), F.min("low").over(roll(3)).alias("rolling_weekly_low"))
    h4 = m.stage("h4", lambda: number_rows(resample.complete(m.bars(), 14400, 3600).withColumnRenamed("bucket", "ts"), span_seconds=4096 * 14400))
    al = sign3((c("ema_8") > c("ema_21")) & (c("ema_21") > c("ema_50")), (c("ema_8") < c("ema_21")) & (c("ema_21") < c("ema_50")))
    h = ff.with_smooth(h4, weeks=104).withColumns({"htf_ema_alignment": al, "htf_close": c("close")})
    out = asof(b, day, "decision_ts", "close_ts", ["prev_day_high", "prev_day_low", "rolling_daily_high", "rolling_daily_low"])
    out = m.stage("htf_day", lambda: out)
    out = asof(out, week, "decision_ts", "close_ts", ["rolling_weekly_high", "rolling_weekly_low"])
    return asof(m.stage("htf_week", lambda: out), h, "decision_ts", "close_ts", ["htf_ema_alignment", "htf_close"])


_SAT = f"CAST({NYSQL} - INTERVAL 12 HOUR AS DATE)"


@query("wn22_weekly_blocks", "symbol:s block:l own_rows:l halo_rows:l", f"""WITH b AS (SELECT symbol, bar_idx, CAST(date_diff('day', DATE '1970-01-03', {_SAT} - CAST((isodow({_SAT}) + 1) % 7 AS INTEGER)) / 7 AS BIGINT) AS block FROM bars),
 st AS (SELECT symbol, block, min(bar_idx) AS s, count(*) AS own_rows FROM b GROUP BY 1, 2) SELECT symbol, block, own_rows, least(s, 100) AS halo_rows FROM st""")
def _(m):
    d = weekly_spread(m.bars(), warmup=100, weeks=1)
    return d.groupBy("symbol", "block").agg(F.sum(flag(c("own"))).alias("own_rows"), F.sum(flag(~c("own"))).alias("halo_rows"))


_MV = f"OVER (PARTITION BY symbol, isl ORDER BY bar_idx ROWS 19 PRECEDING)"


@query("wn23_expected_move", KEY + "expected_move", f"""SELECT *, CASE WHEN ok AND count(mv) {_MV} = 20 THEN avg(mv) {_MV} END AS expected_move FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER ({S}) AS isl, CASE WHEN ok THEN abs(close - pc) / 0.25 END AS mv FROM (
 SELECT *, coalesce(epoch(ts) - epoch({s_lag('ts')}) = 3600, false) AS ok, {s_lag('close')} AS pc FROM bars))""")
def _(m):
    def build(d, w):
        ok = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp(w.lag("ts")) == 3600, F.lit(False))
        d = d.withColumns({"mv": F.when(ok, F.abs(c("close") - w.lag("close")) / 0.25)})
        # a full window of 20 valid moves cannot contain a break
        return d.withColumn("expected_move", w.mean("mv", 20))
    return blocked(m.bars(), build, before=21)


# ---- regimes and events -----------------------------------------------------------------------------------------------------
_RK = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 99 PRECEDING)"


@query("dt13_regimes", KEY + "trend_regime:s vol_regime:s stress_regime:s composite_regime:s", f"""SELECT *, trend_regime || '_' || vol_regime AS composite_regime FROM (SELECT *, CASE ema_alignment WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'range' END AS trend_regime,
 CASE WHEN rk IS NULL THEN 'unknown' WHEN rk <= 0.25 THEN 'low' WHEN rk >= 0.75 THEN 'high' ELSE 'normal' END AS vol_regime, CASE WHEN range_shock_20 >= 2 THEN 'stress' ELSE 'calm' END AS stress_regime FROM (
 SELECT *, CASE WHEN atr_14 IS NOT NULL THEN (len(list_filter(bx, lambda z: z < atr_14)) + (len(list_filter(bx, lambda z: z = atr_14)) + 1) / 2.0) / len(bx) END AS rk FROM (SELECT *, list(atr_14) FILTER (atr_14 IS NOT NULL) {_RK} AS bx FROM trend)))""")
def _(m):
    def build(d, w):
        d = ff.trend(ff.volatility(d, w), w)
        bx = F.collect_list("atr_14").over(w.rows(-99, 0))
        rk = (F.size(F.filter(bx, lambda x: x < c("atr_14"))) + (F.size(F.filter(bx, lambda x: x == c("atr_14"))) + 1) / 2.0) / F.when(F.size(bx) > 0, F.size(bx))
        d = d.withColumn("rk", F.when(c("atr_14").isNotNull(), rk))
        d = d.withColumns({"trend_regime": F.when(c("ema_alignment") == 1, "up").when(c("ema_alignment") == -1, "down").otherwise("range"),
                           "vol_regime": F.when(c("rk").isNull(), "unknown").when(c("rk") <= 0.25, "low").when(c("rk") >= 0.75, "high").otherwise("normal"),
                           "stress_regime": F.when(c("range_shock_20") >= 2, "stress").otherwise("calm")})
        return d.withColumn("composite_regime", F.concat_ws("_", "trend_regime", "vol_regime"))
    return blocked(ff.with_smooth(m.bars()), build, before=200)


@query("dt14_cusum_events", KEY + "cusum:l", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT symbol, bar_idx, ln(close / {s_lag('close')}) AS r, 1.5 * rolling_vol_20 AS thr FROM vol),
 a AS MATERIALIZED (SELECT *, coalesce(thr > 0, false) AND r IS NOT NULL AS live FROM t),
 q AS (SELECT symbol, bar_idx, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, 0 AS cusum FROM a WHERE bar_idx = 0 UNION ALL
 SELECT symbol, bar_idx, CASE WHEN live AND s <> 0 THEN 0.0 WHEN live THEN pp ELSE p END, CASE WHEN live AND s <> 0 THEN 0.0 WHEN live THEN nn ELSE n END, CASE WHEN live THEN s ELSE 0 END FROM (
 SELECT a.symbol, a.bar_idx, a.live, q.p, q.n, greatest(0, q.p + a.r) AS pp, least(0, q.n + a.r) AS nn, CASE WHEN greatest(0, q.p + a.r) >= a.thr THEN 1 WHEN least(0, q.n + a.r) <= -a.thr THEN -1 ELSE 0 END AS s
 FROM q JOIN a ON a.symbol = q.symbol AND a.bar_idx = q.bar_idx + 1)) SELECT * FROM q""")
def _(m):
    def run(p, state):
        signs, left = cusum(p["close"], p["thr"].astype(float), p["before"].astype(float), state)
        return {"cusum": signs}, left
    d = blocked(m.bars(), lambda r, w: ff.volatility(r, w).withColumn("before", w.lag("close")), before=61).withColumn("thr", 1.5 * c("rolling_vol_20"))
    return chained(d, run, [0.0, 0.0], "cusum int", ["close", "thr", "before"])


@query("dt16_breakout_events", KEY + "side:l accepted:l", """WITH RECURSIVE e AS MATERIALIZED (SELECT symbol, side, bar_idx, row_number() OVER (PARTITION BY symbol, side ORDER BY bar_idx) AS rn FROM ev WHERE family = 'breakout'),
 r AS (SELECT symbol, side, bar_idx, rn, bar_idx AS kept, 1 AS accepted FROM e WHERE rn = 1 UNION ALL SELECT e.symbol, e.side, e.bar_idx, e.rn, CASE WHEN e.bar_idx - r.kept > 12 THEN e.bar_idx ELSE r.kept END,
 CASE WHEN e.bar_idx - r.kept > 12 THEN 1 ELSE 0 END FROM r JOIN e ON e.symbol = r.symbol AND e.side = r.side AND e.rn = r.rn + 1) SELECT * FROM r""")
def _(m):
    return lb.cooldown(events(m).filter("family = 'breakout'"), 12, ("symbol", "side"))


# ---- outcomes ---------------------------------------------------------------------------------------------------------------
shared("slots", "SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS slot FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY 1)")
_TU = lambda x: f"ceil(({x}) / 0.25 - 1e-9) * 0.25"
_TD = lambda x: f"floor(({x}) / 0.25 + 1e-9) * 0.25"
shared("sig", f"""SELECT e.symbol, e.bar_idx, e.side, e.atr, s.slot AS known_slot, e.session_regime, n.open AS entry, CASE WHEN e.side = 1 THEN {_TU('n.open + 1.5 * e.atr')} ELSE {_TD('n.open - 1.5 * e.atr')} END AS target_px,
 CASE WHEN e.side = 1 THEN {_TD('n.open - e.atr')} ELSE {_TU('n.open + e.atr')} END AS stop_px FROM ev e JOIN slots s ON s.symbol = e.symbol AND s.ts = e.ts LEFT JOIN (SELECT s.symbol, s.slot, b.open FROM slots s LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = s.ts) n ON n.symbol = e.symbol AND n.slot = s.slot + 1""")
OUT = f"""SELECT *, CASE WHEN status IN ('DATA_GAP', 'UNRESOLVED') THEN NULL ELSE mv END AS move FROM (SELECT s.*, (coalesce(g.px, g.zpx) - s.entry) * s.side AS mv, CASE WHEN g.zstep IS NULL THEN 'UNRESOLVED' WHEN g.kind IS NOT NULL THEN g.kind WHEN g.zstep < 11 THEN 'UNRESOLVED'
 WHEN (g.zpx - s.entry) * s.side > 0 THEN 'TIMEOUT_WIN' WHEN (g.zpx - s.entry) * s.side < 0 THEN 'TIMEOUT_LOSS' ELSE 'TIMEOUT_FLAT' END AS status FROM sig s LEFT JOIN (
 SELECT symbol, bar_idx, arg_min(kind, step) FILTER (kind IS NOT NULL) AS kind, arg_min(CASE kind WHEN 'TARGET' THEN target_px WHEN 'STOP' THEN CASE WHEN (side = 1 AND open <= stop_px) OR (side = -1 AND open >= stop_px) THEN open ELSE stop_px END END, step) FILTER (kind IN ('TARGET', 'STOP')) AS px,
 max(step) AS zstep, arg_max(close, step) AS zpx FROM (SELECT s.*, t.slot - s.known_slot - 1 AS step, b.open, b.close, CASE WHEN b.ts IS NULL THEN 'DATA_GAP' WHEN (s.side = 1 AND b.low <= s.stop_px) OR (s.side = -1 AND b.high >= s.stop_px) THEN 'STOP'
 WHEN (s.side = 1 AND b.high >= s.target_px) OR (s.side = -1 AND b.low <= s.target_px) THEN 'TARGET' END AS kind FROM sig s JOIN slots t ON t.symbol = s.symbol AND t.slot BETWEEN s.known_slot + 1 AND s.known_slot + 12 LEFT JOIN bars b ON b.symbol = t.symbol AND b.ts = t.ts) GROUP BY 1, 2) g
 ON g.symbol = s.symbol AND g.bar_idx = s.bar_idx)"""


def outcomes(m):
    def build():
        sched = m.stage("slots", lambda: number_rows(spine(m.bars(), 3600).withColumnRenamed("slot", "ts"), name="slot"))
        sig = events(m).join(sched.withColumnRenamed("slot", "known_slot"), ["symbol", "ts"])
        return oc.signal_outcome(sig, sched, m.bars().select("symbol", "ts", "open", "high", "low", "close"), 12, 0.25, 1.5, 1.0)
    return m.stage("outcomes", build)


@query("outcome01_signal_outcome", KEY + "entry target_px stop_px status:s move", OUT)
def _(m):
    return outcomes(m)


@query("outcome02_forward_response", KEY + "h:l bars:l status:s move move_pct move_log move_atr mfe mae", "SELECT *, CASE WHEN bars = h THEN mv END AS move, CASE WHEN bars = h THEN mv / close END AS move_pct, CASE WHEN bars = h AND px > 0 AND close > 0 THEN side * ln(px / close) END AS move_log, CASE WHEN bars = h AND atr > 0 THEN mv / atr END AS move_atr, CASE WHEN bars = h THEN 'COMPLETE' WHEN bars = 0 THEN 'NO_ENTRY' ELSE 'INCOMPLETE' END AS status FROM (SELECT e.symbol, e.bar_idx, e.side, e.close, e.atr, h.h, count(b.bar_idx) AS bars, arg_max(b.close, b.bar_idx) AS px, arg_max((b.close - e.close) * e.side, b.bar_idx) AS mv, max(CASE WHEN e.side = 1 THEN b.high - e.close ELSE e.close - b.low END) AS mfe, min(CASE WHEN e.side = 1 THEN b.low - e.close ELSE e.close - b.high END) AS mae FROM ev e CROSS JOIN (VALUES (1), (3), (6), (12), (24), (48)) h(h) LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + h.h GROUP BY 1, 2, 3, 4, 5, 6)")
def _(m):
    from barloom.operators.relate import path
    horizons = (1, 3, 6, 12, 24, 48)
    every = F.array(*[F.lit(x) for x in horizons])
    e = events(m).select("symbol", "bar_idx", "side", "close", "atr")
    p = path(e, m.bars(), c("bar_idx") + 1, c("bar_idx") + horizons[-1], ("high", "low", "close"))
    up = c("side") == 1
    p = p.withColumns({"_f": F.when(up, c("p_high") - c("close")).otherwise(c("close") - c("p_low")), "_a": F.when(up, c("p_low") - c("close")).otherwise(c("close") - c("p_high")), "_m": (c("p_close") - c("close")) * c("side")})
    p = p.withColumn("h", F.explode(F.filter(every, lambda h: h > c("step"))))
    g = p.groupBy("symbol", "bar_idx", "side", "h").agg(F.max_by("_m", "step").alias("_move"), F.max_by("p_close", "step").alias("_px"), F.max("_f").alias("mfe"), F.min("_a").alias("mae"), F.count(F.lit(1)).alias("bars"))
    g = e.withColumn("h", F.explode(every)).join(g, ["symbol", "bar_idx", "side", "h"], "left").withColumn("bars", F.coalesce("bars", F.lit(0)))  # events without a whole path stay, with a status
    done = c("bars") == c("h")
    return g.withColumns({"status": F.when(done, "COMPLETE").when(c("bars") == 0, "NO_ENTRY").otherwise("INCOMPLETE"), "move": F.when(done, c("_move")), "move_pct": F.when(done, c("_move") / c("close")),
                          "move_log": F.when(done & (c("_px") > 0) & (c("close") > 0), c("side") * F.log(c("_px") / c("close"))), "move_atr": F.when(done & (c("atr") > 0), c("_move") / c("atr"))})


SPREAD = [("asia", 1.2), ("london", 0.8), ("overlap", 0.6), ("new_york", 0.9), ("off_hours", 1.5)]
_SPSQL = "(VALUES " + ", ".join(f"('{a}', {b})" for a, b in SPREAD) + ")"
shared("costed", f"SELECT t.*, (a.spread + b.spread) / 2 + 0.2 + 0.05 AS cost FROM trades t JOIN sess x ON x.symbol = t.symbol AND x.bar_idx = t.exit_idx JOIN {_SPSQL} a(r, spread) ON a.r = t.session_regime JOIN {_SPSQL} b(r, spread) ON b.r = x.session_regime")


def costed(m):
    x = ff.session(m.bars()).select("symbol", c("bar_idx").alias("exit_idx"), c("session_regime").alias("exit_session"))
    t = trades(m).withColumnRenamed("session_regime", "entry_session").join(x, ["symbol", "exit_idx"])
    return oc.position_costs(t, m.spark.createDataFrame(SPREAD, "session_regime string, spread double"), 0.1, 0.05)


@query("outcome03_position_costs", KEY + "pnl cost", "SELECT * FROM costed")
def _(m):
    return costed(m)


ADMIT = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER ({S}) AS rn FROM trades), r AS (SELECT symbol, bar_idx, rn, exit_idx AS free, 1 AS admitted FROM e WHERE rn = 1
 UNION ALL SELECT e.symbol, e.bar_idx, e.rn, CASE WHEN e.bar_idx > r.free THEN e.exit_idx ELSE r.free END, CASE WHEN e.bar_idx > r.free THEN 1 ELSE 0 END FROM r JOIN e ON e.symbol = r.symbol AND e.rn = r.rn + 1) SELECT * FROM r"""


@query("outcome04_chronological_admission", KEY + "admitted:l", ADMIT)
def _(m):
    return lb.admit(trades(m))


@query("lb16_label_backtest", "symbol:s family:s taken:l pnl", f"SELECT t.symbol, t.family, count(*) AS taken, sum(t.pnl) AS pnl FROM trades t JOIN ({ADMIT}) a ON a.symbol = t.symbol AND a.bar_idx = t.bar_idx WHERE a.admitted = 1 GROUP BY 1, 2")
def _(m):
    return lb.admit(trades(m)).filter("admitted = 1").groupBy("symbol", "family").agg(F.count(F.lit(1)).alias("taken"), F.sum("pnl").alias("pnl"))


@query("outcome05_cost_cases", "cost_case:s trades:l net", "SELECT k AS cost_case, count(*) AS trades, sum(pnl - cost * f) AS net FROM costed CROSS JOIN (VALUES ('base', 1.0), ('double', 2.0), ('zero', 0.0)) v(k, f) GROUP BY 1")
def _(m):
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in (("base", 1.0), ("double", 2.0), ("zero", 0.0))]))
    d = costed(m).withColumn("v", cases)
    return d.groupBy(c("v.k").alias("cost_case")).agg(F.count(F.lit(1)).alias("trades"), F.sum(c("pnl") - c("cost") * c("v.f")).alias("net"))


@query("outcome08_abstain_cascade", "model_id:s symbol:s bar_idx:l abstain_reason:s", "SELECT *, CASE WHEN session_regime = 'off_hours' THEN 'off_hours' WHEN session_regime = 'asia' AND model_id = 'm2' THEN 'session' WHEN probability < 0.5 THEN 'probability' END AS abstain_reason FROM pred")
def _(m):
    return oc.abstain(predictions(m), [("off_hours", c("session_regime") == "off_hours"), ("session", (c("session_regime") == "asia") & (c("model_id") == "m2")), ("probability", c("probability") < 0.5)])


@query("outcome11_walk_forward_folds", "train_start:t train_end:t test_start:t test_end:t", """SELECT a AS train_start, q - INTERVAL 5 DAY AS train_end, q AS test_start, q + INTERVAL 3 MONTH AS test_end FROM (SELECT a, unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTH)) AS q FROM (SELECT min(ts) AS a, max(ts) AS b FROM daily))
 WHERE q >= date_trunc('quarter', a) + INTERVAL 24 MONTH""")
def _(m):
    return oc.quarter_folds(m.daily(), "ts", 8, 5)


@query("outcome13_emitted_trades", KEY + "model_id:s outcome_class:s pnl", "SELECT t.symbol, t.bar_idx, p.model_id, CASE WHEN t.pnl > 0 THEN 'win' WHEN t.pnl < 0 THEN 'loss' ELSE 'flat' END AS outcome_class, t.pnl FROM trades t JOIN pred p ON p.symbol = t.symbol AND p.bar_idx = t.bar_idx WHERE p.probability >= 0.5")
def _(m):
    p = predictions(m).filter("probability >= 0.5").select("symbol", "bar_idx", "model_id")
    return trades(m).join(p, ["symbol", "bar_idx"]).withColumn("outcome_class", F.when(c("pnl") > 0, "win").when(c("pnl") < 0, "loss").otherwise("flat"))


@query("ag36_filter_attribution", "population:s " + SUMOUT, f"SELECT population, {SUMSQL} FROM (SELECT *, CASE WHEN session_regime IN ('london', 'overlap') THEN 'accepted' ELSE 'rejected' END AS population FROM trades UNION ALL SELECT *, 'all' FROM trades) GROUP BY 1")
def _(m):
    t = trades(m)
    kept = t.withColumn("population", F.when(c("session_regime").isin("london", "overlap"), "accepted").otherwise("rejected"))
    return mt.summary(kept.unionByName(t.withColumn("population", F.lit("all"))), ["population"])


@query("ag38_label_summary", "family:s side:l labels:l positives:l rate", "SELECT family, side, count(*) AS labels, sum(CASE WHEN outcome = 'tp' THEN 1 ELSE 0 END) AS positives, avg(CASE WHEN outcome = 'tp' THEN 1.0 ELSE 0 END) AS rate FROM lb01 GROUP BY 1, 2")
def _(m):
    y = flag(c("outcome") == "tp")
    return labelled(m).groupBy("family", "side").agg(F.count(F.lit(1)).alias("labels"), F.sum(y).alias("positives"), F.avg(y).alias("rate"))


@query("ag39_label_diagnostics", "hour:l events:l positive_rate", "SELECT hour(ts) AS hour, count(*) AS events, avg(CASE WHEN outcome = 'tp' THEN 1.0 ELSE 0 END) AS positive_rate FROM lb01 GROUP BY 1")
def _(m):
    return labelled(m).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.avg(flag(c("outcome") == "tp")).alias("positive_rate"))


@query("ag52_leakage_audit", "family:s events:l crossing:l max_window:l", "SELECT family, count(*) AS events, sum(CASE WHEN (bar_idx < t1 AND exit_idx >= t1) OR (bar_idx < t2 AND exit_idx >= t2) THEN 1 ELSE 0 END) AS crossing, max(exit_idx - bar_idx) AS max_window FROM lb01 JOIN bounds USING (symbol) WHERE outcome IS NOT NULL GROUP BY 1")
def _(m):
    from barloom.plans.storage import bounds
    cross = ((c("bar_idx") < c("t1")) & (c("exit_idx") >= c("t1"))) | ((c("bar_idx") < c("t2")) & (c("exit_idx") >= c("t2")))
    return labelled(m).join(bounds(m), "symbol").filter("outcome is not null").groupBy("family").agg(F.count(F.lit(1)).alias("events"), F.sum(flag(cross)).alias("crossing"), F.max(c("exit_idx") - c("bar_idx")).alias("max_window"))


@query("ag34_promotion_gate", "model_id:s accepted:l", "SELECT model_id, CASE WHEN bool_and(ok) THEN 1 ELSE 0 END AS accepted FROM (SELECT model_id, session_regime, avg(target) >= 0.45 AS ok FROM pred GROUP BY 1, 2) GROUP BY 1")
def _(m):
    g = predictions(m).groupBy("model_id", "session_regime").agg((F.avg("target") >= 0.45).alias("ok"))
    return g.groupBy("model_id").agg(flag(F.bool_and("ok")).alias("accepted"))


@query("ag57_markout_summary", "family:s completed:l open_count:l win_rate mean_units total_units", "SELECT e.family, count(b.close) AS completed, count(*) - count(b.close) AS open_count, avg(CASE WHEN b.close IS NOT NULL THEN CASE WHEN (b.close - e.close) * e.side > 0 THEN 1.0 ELSE 0 END END) AS win_rate, avg((b.close - e.close) * e.side) AS mean_units, sum((b.close - e.close) * e.side) AS total_units FROM ev e LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 12 GROUP BY 1")
def _(m):
    x = m.bars().select("symbol", (c("bar_idx") - 12).alias("bar_idx"), c("close").alias("px"))
    d = events(m).join(x, ["symbol", "bar_idx"], "left").withColumn("u", (c("px") - c("close")) * c("side"))
    return d.groupBy("family").agg(F.count("u").alias("completed"), F.sum(flag(c("u").isNull())).alias("open_count"), F.avg(F.when(c("u").isNotNull(), flag(c("u") > 0))).alias("win_rate"),
                                   F.avg("u").alias("mean_units"), F.sum("u").alias("total_units"))

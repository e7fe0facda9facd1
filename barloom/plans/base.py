"""PRJ, SC, ST rows, resampling aggregates (AG01-AG04) and the generic joins (JN01-JN05, JN11, JN22-JN26, JN29)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock, cols
from barloom.functions.cols import c, flag
from barloom.operators import features as ff
from barloom.operators import resample
from barloom.operators.blocks import blocked, carry_last
from barloom.operators.relate import asof, within
from barloom.plans.registry import (S, TR, query, s_div, s_flag, s_lag, s_last, s_max, s_mean, s_min, s_since, shared)

KEY = "symbol:s bar_idx:l "
NYSQL = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'"
LAST_TS = "(SELECT max(ts) FROM bars)"

# ---- projections and predicates ---------------------------------------------------------------------------------------------


@query("prj01_ohlc_validity", "symbol:s rows:l invalid:l", """SELECT symbol, count(*) AS rows,
 sum(CASE WHEN price IS NULL OR high < greatest(open, close2, low) OR low > least(open, close2, high) THEN 1 ELSE 0 END) AS invalid
 FROM (SELECT *, close AS price, CASE WHEN bar_idx % 7 = 0 THEN high + 1 ELSE close END AS close2 FROM bars) GROUP BY symbol""")
def _(m):
    b = m.bars().withColumn("close", F.when(c("bar_idx") % 7 == 0, c("high") + 1).otherwise(c("close")))
    bad = c("close").isNull() | (c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high"))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum(flag(bad)).alias("invalid"))


@query("prj02_anomaly_count", "symbol:s anomalies:l", f"""SELECT symbol, sum({s_flag('high < low OR close > high OR close < low OR (atr > 0 AND high - low > 3 * atr) OR volume <= 0')}) AS anomalies
 FROM (SELECT *, {s_mean('tr', 20)} AS atr FROM (SELECT *, {TR} AS tr FROM bars)) GROUP BY symbol""")
def _(m):
    def build(d, w):
        d = d.withColumn("tr", cols.true_range(w))
        return d.withColumn("atr", w.mean("tr", 20))
    bad = ((c("high") < c("low")) | (c("close") > c("high")) | (c("close") < c("low")) | ((c("atr") > 0) & (c("high") - c("low") > 3 * c("atr")))
           | (c("volume") <= 0))
    return blocked(m.bars(), build, before=21).groupBy("symbol").agg(F.sum(flag(bad)).alias("anomalies"))


@query("prj03_date_range", KEY + "ts:t close", "SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'")
def _(m):
    return m.bars().filter((c("ts") >= F.lit("2024-01-10").cast("timestamp")) & (c("ts") < F.lit("2024-01-13").cast("timestamp")))


@query("prj04_safe_divide", KEY + "body_share body_share_filled",
       f"SELECT *, {s_div('close - open', 'high - low')} AS body_share, {s_div('close - open', 'high - low', 0.5)} AS body_share_filled FROM bars")
def _(m):
    n, d = c("close") - c("open"), c("high") - c("low")
    return m.bars().withColumns({"body_share": cols.safe_div(n, d), "body_share_filled": cols.safe_div(n, d, 0.5)})


@query("prj05_inf_to_null", KEY + "ratio", "SELECT *, CASE WHEN high <> low THEN close / (high - low) END AS ratio FROM bars")
def _(m):
    raw = F.when(c("high") == c("low"), F.lit(float("inf"))).otherwise(c("close") / (c("high") - c("low")))
    return m.bars().withColumn("ratio", cols.finite(raw))


@query("prj06_numeric_fill", KEY + "filled", f"SELECT *, coalesce({s_last('CASE WHEN volume > 3 THEN close END')}, 0) AS filled FROM bars")
def _(m):
    out = carry_last(m.bars(), {"filled": F.when(c("volume") > 3, c("close"))})
    return out.withColumn("filled", F.coalesce("filled", F.lit(0.0)))


@query("prj07_warmup_drop", KEY + "close", "SELECT * FROM bars WHERE bar_idx >= 200")
def _(m):
    return m.bars().filter("bar_idx >= 200")


@query("prj08_append_if_absent", KEY + "close candle_range", "SELECT *, high - low AS candle_range FROM bars")
def _(m):
    new = {"close": F.lit(0.0), "candle_range": c("high") - c("low")}
    b = m.bars()
    return b.withColumns({k: v for k, v in new.items() if k not in b.columns})


@query("prj09_one_hot", KEY + "strategy__dir__signal__long:l strategy__dir__signal__short:l strategy__dir__signal__missing:l",
       f"""SELECT *, {s_flag("sig = 'long'")} AS strategy__dir__signal__long, {s_flag("sig = 'short'")} AS strategy__dir__signal__short,
 {s_flag("sig = 'missing'")} AS strategy__dir__signal__missing FROM (SELECT *, coalesce(CASE WHEN close > open THEN 'long' WHEN close < open THEN 'short' END, 'missing') AS sig FROM bars)""")
def _(m):
    from barloom.operators.strategies import one_hot
    return one_hot(m.bars().withColumn("signal", F.when(c("close") > c("open"), "long").when(c("close") < c("open"), "short")), "dir", "signal",
                   ["long", "short", "missing"])


@query("prj10_absent_one_hot", KEY + "strategy__dir__signal__long:l strategy__dir__signal__neutral:l",
       f"SELECT *, {s_flag('close > open')} AS strategy__dir__signal__long, 0 AS strategy__dir__signal__neutral FROM bars")
def _(m):
    from barloom.operators.strategies import complete_vocabulary
    b = m.bars().withColumn("strategy__dir__signal__long", flag(c("close") > c("open")))
    return complete_vocabulary(b, ["strategy__dir__signal__long", "strategy__dir__signal__neutral", "strategy__other__signal__long"])


@query("prj12_interval_retune", "symbol:s bar_minutes warmup_rows:l window_20:l", """SELECT symbol, minutes AS bar_minutes,
 greatest(1, round(200 * 5.0 / minutes)) AS warmup_rows, greatest(1, round(20 * 5.0 / minutes)) AS window_20 FROM (
 SELECT symbol, arg_max(g, (n, -g)) AS minutes FROM (SELECT symbol, g, count(*) AS n FROM (
 SELECT symbol, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY bar_idx))) / 60.0 AS g FROM bars) WHERE g > 0 GROUP BY 1, 2) GROUP BY 1)""")
def _(m):
    g = blocked(m.bars(), lambda d, w: d.withColumn("g", (F.unix_timestamp("ts") - F.unix_timestamp(w.lag("ts"))) / 60.0), before=1)
    mode = g.filter("g > 0").groupBy("symbol", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(
        F.max_by("g", F.struct("n", -c("g"))).alias("bar_minutes"))
    scale = lambda k: F.greatest(F.lit(1.0), F.round(k * 5.0 / c("bar_minutes")))
    return mode.withColumns({"warmup_rows": scale(200), "window_20": scale(20)})


@query("prj13_session_predicate", KEY + "wrap:l plain:l none:l", f"""SELECT *, {s_flag(f'hour({NYSQL}) >= 19 OR hour({NYSQL}) < 2')} AS wrap,
 {s_flag(f'hour({NYSQL}) * 60 + minute({NYSQL}) BETWEEN 570 AND 959')} AS plain, 0 AS none FROM bars""")
def _(m):
    t = clock.local("ts")
    return m.bars().withColumns({"wrap": flag(clock.in_clock(t, 19, 2)), "plain": flag(clock.in_clock(t, 9, 16, 30)), "none": flag(clock.in_clock(t, 5, 5))})


_MIN = f"hour({NYSQL}) * 60 + minute({NYSQL})"


@query("prj14_fx_market_open", KEY + "open_flag:l", f"""SELECT *, {s_flag(f'NOT (isodow({NYSQL}) = 6 OR (isodow({NYSQL}) = 7 AND {_MIN} <= 1020) OR (isodow({NYSQL}) = 5 AND {_MIN} >= 1020))')} AS open_flag FROM bars""")
def _(m):
    return m.bars().withColumn("open_flag", flag(clock.fx_open()))


FUT = f"""CASE WHEN isodow({NYSQL}) = 6 THEN false WHEN isodow({NYSQL}) = 7 THEN {_MIN} >= 1080 WHEN isodow({NYSQL}) = 5 THEN {_MIN} < 1020 ELSE {_MIN} < 1020 OR {_MIN} >= 1080 END"""


@query("prj15_futures_market_open", KEY + "open_flag:l", f"SELECT *, {s_flag(FUT)} AS open_flag FROM bars")
def _(m):
    return m.bars().withColumn("open_flag", flag(clock.futures_open()))


HOURS = "20240102:0930-1600;20240103:0930-1200,1300-1600;20240104:CLOSED;20240105:1800-0200"


@query("prj16_broker_hours", "symbol:s ts:t covered:l open_flag:l", f"""WITH iv(a, b) AS (VALUES (TIMESTAMP '2024-01-02 09:30:00', TIMESTAMP '2024-01-02 16:00:00'),
 (TIMESTAMP '2024-01-03 09:30:00', TIMESTAMP '2024-01-03 12:00:00'), (TIMESTAMP '2024-01-03 13:00:00', TIMESTAMP '2024-01-03 16:00:00'),
 (TIMESTAMP '2024-01-05 18:00:00', TIMESTAMP '2024-01-06 02:00:00')), days(d0, d1) AS (VALUES (DATE '2024-01-02', DATE '2024-01-02'), (DATE '2024-01-03', DATE '2024-01-03'),
 (DATE '2024-01-04', DATE '2024-01-04'), (DATE '2024-01-05', DATE '2024-01-06'))
 SELECT symbol, ts, CASE WHEN covered THEN 1 ELSE 0 END AS covered, CASE WHEN covered THEN CASE WHEN op THEN 1 ELSE 0 END END AS open_flag FROM (
 SELECT symbol, ts, EXISTS (SELECT 1 FROM days WHERE CAST(l AS DATE) BETWEEN d0 AND d1) AS covered, EXISTS (SELECT 1 FROM iv WHERE l >= a AND l < b) AS op
 FROM (SELECT *, {NYSQL} AS l FROM bars))""")
def _(m):
    from barloom.operators.calendars import broker_open
    return broker_open(m.bars(), HOURS)


@query("prj17_finalised_bars", KEY + "close", f"SELECT * FROM bars WHERE ts <= date_trunc('hour', {LAST_TS} + INTERVAL 100 MINUTE - INTERVAL 90 SECOND - INTERVAL 1 HOUR)")
def _(m):
    from barloom.operators.provenance import finalised
    b = m.bars()
    now = b.agg((F.max("ts") + F.expr("INTERVAL 100 MINUTES")).alias("now"))
    return finalised(b, now, 3600, 90)


ELIG_REASONS = {  # reason -> SQL condition on the fixture columns
    "bar_incomplete": "is_complete = false", "bar_completion_unknown": "is_complete IS NULL", "bar_not_closed": "delay < 0", "bar_stale": "delay > 90",
    "first_observation_unknown": "first_obs IS NULL", "observation_after_prediction": "first_obs > recorded",
    "feed_not_live": "feed <> 'live'", "backfilled_evaluation": "kind = 'backfill'", "observation_kind_unknown": "kind NOT IN ('live', 'backfill')",
    "source_bar_market_closed": f"NOT ({FUT})"}


@query("prj18_bar_eligibility", KEY + "eligible:l reasons:s evaluation_kind:s", f"""SELECT symbol, bar_idx, CASE WHEN reasons = '' THEN 1 ELSE 0 END AS eligible, reasons,
 CASE WHEN kind = 'backfill' THEN 'backfilled' WHEN delay > 90 THEN 'delayed' WHEN is_complete = false OR delay < 0 THEN 'provisional' WHEN reasons = '' THEN 'live' ELSE 'diagnostic' END AS evaluation_kind
 FROM (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in ELIG_REASONS.items())}) AS reasons FROM (
 SELECT *, CASE bar_idx % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS is_complete, (bar_idx * 37) % 150 - 20 AS delay,
 CASE WHEN bar_idx % 11 <> 0 THEN ts + INTERVAL 3610 SECOND END AS first_obs, ts + INTERVAL 3600 SECOND + ((bar_idx * 37) % 150 - 20) * INTERVAL 1 SECOND AS recorded,
 CASE WHEN bar_idx % 7 = 0 THEN 'delayed' ELSE 'live' END AS feed, CASE bar_idx % 9 WHEN 0 THEN 'backfill' WHEN 1 THEN 'other' ELSE 'live' END AS kind FROM bars))""")
def _(m):
    from barloom.operators.provenance import eligibility
    i = c("bar_idx")
    b = m.bars().withColumns({
        "is_complete": F.when(i % 5 == 0, F.lit(None).cast("boolean")).when(i % 5 == 1, False).otherwise(True),
        "recorded_at": F.timestamp_seconds(F.unix_timestamp("ts") + 3600 + (i * 37) % 150 - 20),
        "first_observed_at": F.when(i % 11 != 0, F.timestamp_seconds(F.unix_timestamp("ts") + 3610)),
        "feed_type": F.when(i % 7 == 0, "delayed").otherwise("live"), "observation_kind": F.when(i % 9 == 0, "backfill").when(i % 9 == 1, "other").otherwise("live")})
    return eligibility(b, 3600, clock.futures_open())


REQ = [("m1", "close_return_1"), ("m1", "atr_14"), ("m2", "atr_50"), ("m2", "rolling_vol_60"), ("m3", "absent_feature")]
_REQSQL = ", ".join(f"('{a}', '{b}')" for a, b in REQ)


@query("prj19_model_input_contract", "symbol:s model_id:s status:s reasons:s available:l", f"""SELECT symbol, model_id, CASE WHEN count(*) FILTER (reason IS NOT NULL) > 0 THEN 'diagnostic_only' ELSE 'passed' END AS status,
 coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, count(*) FILTER (reason IS NULL) AS available FROM (
 SELECT l.symbol, r.model_id, CASE WHEN f.feature IS NULL THEN 'missing_producer' WHEN f.value IS NULL THEN 'missing_history_or_input' END AS reason
 FROM (VALUES {_REQSQL}) r(model_id, feature) CROSS JOIN (SELECT DISTINCT symbol FROM bars) l LEFT JOIN (
 SELECT symbol, unnest(['close_return_1', 'atr_14', 'atr_50', 'rolling_vol_60']) AS feature,
 unnest([close_return_1, atr_14, atr_50, CASE WHEN symbol <> 'view' THEN rolling_vol_60 END]) AS value FROM vol
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) = 1) f
 ON f.symbol = l.symbol AND f.feature = r.feature) GROUP BY 1, 2""")
def _(m):
    from barloom.operators.provenance import input_contract
    d = blocked(m.bars(), lambda d, w: ff.volatility(ff.price_action(d, w), w), before=61)
    d = d.withColumn("rolling_vol_60", F.when(c("symbol") != "view", c("rolling_vol_60")))
    return input_contract(d, ["close_return_1", "atr_14", "atr_50", "rolling_vol_60"], m.spark.createDataFrame(REQ, "model_id string, feature string"))


@query("prj20_warmup_status", "symbol:s bars_available:l history_ready:l valid_features:l ready:l", f"""SELECT symbol, n AS bars_available, {s_flag('n >= 670')} AS history_ready,
 v AS valid_features, {s_flag('n >= 670 AND v = 2')} AS ready FROM (SELECT symbol, count(*) AS n, max(CASE WHEN last THEN (CASE WHEN atr_14 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN atr_50 IS NULL THEN 0 ELSE 1 END) END) AS v
 FROM (SELECT *, bar_idx = max(bar_idx) OVER (PARTITION BY symbol) AS last FROM vol) GROUP BY symbol)""")
def _(m):
    from barloom.operators.provenance import warmup_status
    return warmup_status(blocked(m.bars(), ff.volatility, before=61), ["atr_14", "atr_50"], 670)


CAUSAL = [  # ordered rules of a signal's timestamps, all as seconds relative to the bar close
    ("anchor_after_known_at", "anchor > known"), ("confirmation_before_anchor", "confirm < anchor"), ("input_unavailable_at_decision", "greatest(confirm, feat, pred, calib, policy) > known"),
    ("feature_source_after_feature_availability", "src > feat"), ("prediction_pipeline_out_of_order", "NOT (feat <= pred AND pred <= calib AND calib <= policy)"),
    ("regime_unavailable_to_policy", "regime > policy")]
_TSQL = """anchor, confirm, src, feat, pred, calib, policy, regime, known"""
_TDEF = {"anchor": "(i * 7) % 40", "confirm": "(i * 7) % 40 + (i * 3) % 17 - 2", "src": "(i * 5) % 45", "feat": "30 + (i * 2) % 31", "pred": "40 + (i * 2) % 31 - (i % 13) / 6",
         "calib": "42 + (i * 2) % 31", "policy": "44 + (i * 2) % 31", "regime": "40 + (i * 2) % 29", "known": "74"}


@query("prj21_causal_checks", KEY + "reason:s", f"""SELECT symbol, bar_idx, CASE {' '.join(f"WHEN {k} THEN '{r}'" for r, k in CAUSAL)} END AS reason FROM (
 SELECT symbol, bar_idx, {', '.join(f"{v.replace('(i % 13) / 6', '(i % 13) // 6')} AS {k}" for k, v in _TDEF.items())} FROM (SELECT *, bar_idx AS i FROM bars))""")
def _(m):
    from barloom.operators.provenance import first_causal_error
    b = m.bars().withColumn("i", c("bar_idx"))
    b = b.withColumns({k: F.expr(v.replace("(i % 13) / 6", "(i % 13) div 6")) for k, v in _TDEF.items()})
    return first_causal_error(b, "known", {"anchor": "anchor", "confirm": "confirm", "src": "src", "feat": "feat", "pred": "pred", "calib": "calib", "policy": "policy",
                                           "regime": "regime"})


SCOPE = [("view", "included", None), ("click", "diagnostics", "pooled_model_diagnostics_only")]


@query("prj22_research_scope", "symbol:s rows:l reason:s", """SELECT symbol, count(*) AS rows, CASE symbol WHEN 'view' THEN NULL WHEN 'click' THEN 'pooled_model_diagnostics_only' ELSE 'strategy_out_of_scope' END AS reason FROM bars GROUP BY symbol""")
def _(m):
    scope = m.spark.createDataFrame(SCOPE, "symbol string, lane string, why string")
    n = m.bars().groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return n.join(F.broadcast(scope), "symbol", "left").withColumn("reason", F.when(c("lane").isNull(), "strategy_out_of_scope").otherwise(c("why")))


@query("prj23_report_guard", "report:s kinds:l streams:l admissible:l", """SELECT report, count(DISTINCT kind) AS kinds, count(DISTINCT symbol) AS streams,
 CASE WHEN count(DISTINCT kind) = 1 AND count(DISTINCT symbol) = 1 THEN 1 ELSE 0 END AS admissible FROM (
 SELECT symbol, symbol AS report, 'markout' AS kind FROM bars UNION ALL SELECT symbol, 'mixed', CASE WHEN bar_idx % 2 = 0 THEN 'markout' ELSE 'ledger' END FROM bars) GROUP BY 1""")
def _(m):
    from barloom.operators.provenance import report_guard
    b = m.bars()
    r = b.select("symbol", c("symbol").alias("report"), F.lit("markout").alias("kind")).unionByName(
        b.select("symbol", F.lit("mixed").alias("report"), F.when(c("bar_idx") % 2 == 0, "markout").otherwise("ledger").alias("kind")))
    return report_guard(r, "report", {"kinds": "kind", "streams": "symbol"})


@query("prj24_event_overrides", "symbol:s bar_idx:l label:l overridden:l", """SELECT symbol, bar_idx, CASE WHEN bar_idx % 50 = 0 THEN 1 WHEN bar_idx % 50 = 7 THEN 0 ELSE CASE WHEN close > open THEN 1 ELSE 0 END END AS label,
 CASE WHEN bar_idx % 50 IN (0, 7) THEN 1 ELSE 0 END AS overridden FROM bars WHERE volume >= 4""")
def _(m):
    b = m.bars()
    ev = b.filter("volume >= 4").withColumn("label", flag(c("close") > c("open")))
    fixes = b.filter((c("bar_idx") % 50).isin(0, 7)).select("symbol", "bar_idx", F.when(c("bar_idx") % 50 == 0, 1).otherwise(0).alias("fix"))
    out = ev.join(fixes, ["symbol", "bar_idx"], "left")
    return out.withColumns({"overridden": flag(c("fix").isNotNull()), "label": F.coalesce("fix", "label")})


@query("prj25_usable_mask", KEY + "target:l", """SELECT symbol, bar_idx, CASE WHEN close > open THEN 1 ELSE 0 END AS target FROM bars
 WHERE bar_idx >= 50 AND (close > open OR (bar_idx % 3 <> 0 AND volume < 5))""")
def _(m):
    pos, neg_ok, excl = c("close") > c("open"), c("bar_idx") % 3 != 0, c("volume") >= 5
    return m.bars().filter((c("bar_idx") >= 50) & (pos | (neg_ok & ~excl))).withColumn("target", flag(pos))


@query("prj26_unit_aliases", KEY + "gain_pips gain_units", f"SELECT *, (close - open) * 10 AS gain_pips, (close - open) * 10 AS gain_units FROM bars")
def _(m):
    d = m.bars().withColumn("gain_pips", (c("close") - c("open")) * 10)
    return d.withColumns({x[:-5] + "_units": c(x) for x in d.columns if x.endswith("_pips")})


@query("prj27_row_windowing", KEY + "close", "SELECT * FROM bars WHERE bar_idx >= 25")
def _(m):
    return m.bars().filter("bar_idx >= 25")


# ---- resampling and alignment -----------------------------------------------------------------------------------------------
@query("ag01_resample", "symbol:s bucket:t open high low close volume", """SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, arg_min(open, ts) AS open,
 max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def _(m):
    return resample.by_time(m.bars(), 14400)


shared("h4", """SELECT symbol, time_bucket(INTERVAL '4 hours', ts) + INTERVAL 4 HOUR AS close_ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL '4 hours', ts) HAVING count(*) = 4""")


@query("ag02_complete_resample", "symbol:s close_ts:t open high low close volume", "SELECT * FROM h4")
def _(m):
    return resample.complete(m.bars(), 14400, 3600)


DAYCLOSE = f"""(date_trunc('day', {NYSQL} - INTERVAL 17 HOUR) + INTERVAL 41 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'"""
_D = f"CAST(date_trunc('day', {NYSQL} - INTERVAL 17 HOUR) AS DATE) + 1"
WEEKCLOSE = f"""(CAST({_D} AS TIMESTAMP) + ((5 - isodow({_D}) + 7) % 7) * INTERVAL 1 DAY + INTERVAL 17 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'"""
for _nm, _x in (("d1", DAYCLOSE), ("w1", WEEKCLOSE)):
    shared(_nm, f"""SELECT symbol, {_x} AS close_ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
 count(*) AS n FROM bars GROUP BY 1, 2""")


@query("ag03_calendar_resample", "period:s symbol:s close_ts:t open high low close volume n:l", "SELECT 'day' AS period, * FROM d1 UNION ALL SELECT 'week', * FROM w1")
def _(m):
    b = m.bars()
    return (resample.by_close(b, clock.day_close()).withColumn("period", F.lit("day"))
            .unionByName(resample.by_close(b, clock.week_close()).withColumn("period", F.lit("week"))))


@query("ag04_rollup_provenance", "symbol:s bucket:t open high low close volume n:l expected:l covered:l is_complete:s feed_type:s observation_kind:s sources:l",
       f"""SELECT *, CASE WHEN cov THEN 1 ELSE 0 END AS covered, CASE WHEN NOT cov OR partial THEN 'false' WHEN complete THEN 'true' END AS is_complete FROM (
 SELECT r.*, e.expected, coalesce(e.expected = r.n, false) AS cov FROM (
 SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
 count(*) AS n, count(*) AS sources, bool_or(volume < 2) AS partial, bool_and(volume >= 2) AS complete,
 CASE WHEN count(DISTINCT CASE WHEN bar_idx % 10 = 0 THEN 'delayed' ELSE 'live' END) = 1 THEN min(CASE WHEN bar_idx % 10 = 0 THEN 'delayed' ELSE 'live' END) ELSE 'mixed' END AS feed_type,
 CASE WHEN bool_or(bar_idx % 13 = 0) THEN 'backfill' ELSE 'live' END AS observation_kind FROM bars GROUP BY 1, 2) r
 LEFT JOIN (SELECT symbol, bucket, count(*) AS expected FROM (SELECT symbol, bucket, bucket + k * INTERVAL 1 HOUR AS ts FROM (SELECT DISTINCT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket FROM bars)
 CROSS JOIN range(4) g(k)) WHERE {FUT} GROUP BY 1, 2) e ON e.symbol = r.symbol AND e.bucket = r.bucket)""")
def _(m):
    b = m.bars().withColumns({
        "is_complete": c("volume") >= 2, "feed_type": F.when(c("bar_idx") % 10 == 0, "delayed").otherwise("live"), "first_observed_at": c("ts"),
        "last_observed_at": c("ts"), "observation_kind": F.when(c("bar_idx") % 13 == 0, "backfill").otherwise("live")})
    return resample.with_provenance(b, 14400, 3600, clock.futures_open()).withColumn("sources", F.size("source_bars"))


shared("h4x", f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close_ts) - 1 AS bar_idx FROM h4""")
ASOF4 = "SELECT b.*, h.close AS htf_close, h.close_ts AS htf_ts, b.ts + INTERVAL 1 HOUR AS decision_ts FROM bars b ASOF LEFT JOIN h4 h ON b.symbol = h.symbol AND b.ts + INTERVAL 1 HOUR >= h.close_ts"


@query("jn01_asof_htf", KEY + "htf_close htf_age_minutes:l", f"SELECT *, (epoch(decision_ts) - epoch(htf_ts)) / 60 AS htf_age_minutes FROM ({ASOF4})")
def _(m):
    h = resample.complete(m.bars(), 14400, 3600).withColumnRenamed("close", "htf_close")
    out = resample.align(m.bars(), h.withColumn("htf_ts", c("close_ts")), ["htf_close", "htf_ts"], 3600)
    return out.withColumn("htf_age_minutes", (F.unix_timestamp("decision_ts") - F.unix_timestamp("htf_ts")) / 60)


SWH4 = f"""SELECT symbol, ts, {s_flag(f"high > {s_max('high', 2, 1)} AND count(*) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2 AND high > max(high) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)")} AS hi,
 {s_flag(f"low < {s_min('low', 2, 1)} AND count(*) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2 AND low < min(low) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)")} AS lo
 FROM (SELECT *, close_ts - INTERVAL 4 HOUR AS ts, row_number() OVER (PARTITION BY symbol ORDER BY close_ts) - 1 AS bar_idx FROM h4)"""
shared("h4swing", SWH4)


def h4_swings(m):
    from barloom.operators.blocks import number_rows
    h = resample.complete(m.bars(), 14400, 3600).withColumnRenamed("bucket", "ts").drop("close_ts", "n")
    h = number_rows(h, span_seconds=4096 * 14400)
    s = blocked(h, lambda d, w: ff.swings(d, w, 2), before=4, after=2)
    return s.select("symbol", "ts", c("raw_swing_high").alias("hi"), c("raw_swing_low").alias("lo"))


@query("jn02_exact_event_alignment", KEY + "hi:l lo:l", "SELECT b.*, coalesce(h.hi, 0) AS hi, coalesce(h.lo, 0) AS lo FROM bars b LEFT JOIN h4swing h USING (symbol, ts)")
def _(m):
    return m.bars().join(h4_swings(m), ["symbol", "ts"], "left").fillna(0, ["hi", "lo"])


@query("jn03_interval_mark", KEY + "near_hi:l near_lo:l", """SELECT b.symbol, b.bar_idx, max(CASE WHEN h.hi = 1 THEN 1 ELSE 0 END) AS near_hi, max(CASE WHEN h.lo = 1 THEN 1 ELSE 0 END) AS near_lo
 FROM bars b LEFT JOIN h4swing h ON b.symbol = h.symbol AND h.ts BETWEEN b.ts - INTERVAL 2 HOUR AND b.ts + INTERVAL 2 HOUR GROUP BY 1, 2""")
def _(m):
    ev = h4_swings(m).filter("hi + lo > 0").withColumns({"lo_ts": c("ts") - F.expr("INTERVAL 2 HOURS"), "hi_ts": c("ts") + F.expr("INTERVAL 2 HOURS")}).drop("ts")
    hit = within(m.bars().select("symbol", "bar_idx", "ts"), ev, "ts", "lo_ts", "hi_ts", 3 * 3600).groupBy("symbol", "bar_idx").agg(
        F.max("hi").alias("near_hi"), F.max("lo").alias("near_lo"))
    return m.bars().join(hit, ["symbol", "bar_idx"], "left").fillna(0, ["near_hi", "near_lo"])


@query("jn04_nearest_semi", KEY + "close", "SELECT * FROM bars b WHERE close > open AND EXISTS (SELECT 1 FROM h4swing h WHERE h.symbol = b.symbol AND h.lo = 1 AND abs(epoch(h.ts) - epoch(b.ts)) <= 10800)")
def _(m):
    ev = h4_swings(m).filter("lo = 1").select("symbol", (c("ts") - F.expr("INTERVAL 3 HOURS")).alias("lo_ts"), (c("ts") + F.expr("INTERVAL 3 HOURS")).alias("hi_ts"))
    return within(m.bars().filter("close > open"), ev, "ts", "lo_ts", "hi_ts", 3 * 3600, how="left_semi")


@query("jn05_previous_event_distance", KEY + "since_hi:l", "SELECT b.symbol, b.bar_idx, b.bar_idx - e.bar_idx AS since_hi FROM bars b ASOF LEFT JOIN (SELECT bars.symbol, bars.bar_idx FROM bars JOIN h4swing h USING (symbol, ts) WHERE h.hi = 1) e ON b.symbol = e.symbol AND b.bar_idx > e.bar_idx")
def _(m):
    b = m.bars().join(h4_swings(m), ["symbol", "ts"], "left")
    return carry_last(b, {"_e": F.when(c("hi") == 1, c("bar_idx"))}, strict=True).withColumn("since_hi", c("bar_idx") - c("_e"))


@query("jn11_family_merge", KEY + "a_flag:l b_flag:l", f"SELECT bars.*, coalesce(a.f, 0) AS a_flag, coalesce(b.f, 0) AS b_flag FROM bars LEFT JOIN (SELECT symbol, ts, 1 AS f FROM bars WHERE close > open) a USING (symbol, ts) LEFT JOIN (SELECT symbol, ts, 1 AS f FROM bars WHERE volume >= 4) b USING (symbol, ts)")
def _(m):
    from barloom.operators.provenance import merge_families
    b = m.bars()
    return merge_families(b, {"a": b.filter("close > open").select("symbol", "ts", F.lit(1).alias("flag")), "b": b.filter("volume >= 4").select("symbol", "ts", F.lit(1).alias("flag"))})


@query("jn22_prior_period_value", KEY + "prior_day_high prior_week_low", """SELECT b.symbol, b.bar_idx, d.high AS prior_day_high, w.low AS prior_week_low FROM
 (SELECT *, CAST(date_trunc('day', ts) AS DATE) AS dd FROM bars) b ASOF LEFT JOIN (SELECT symbol, CAST(date_trunc('day', ts) AS DATE) AS dd, max(high) AS high FROM bars GROUP BY 1, 2) d ON b.symbol = d.symbol AND b.dd > d.dd
 LEFT JOIN (SELECT symbol, wk, lag(low) OVER (PARTITION BY symbol ORDER BY wk) AS low FROM (SELECT symbol, date_trunc('week', ts) AS wk, min(low) AS low FROM bars GROUP BY 1, 2)) w
 ON w.symbol = b.symbol AND w.wk = date_trunc('week', b.ts)""")
def _(m):
    from barloom.operators.resample import prior_period
    b = m.bars()
    b = prior_period(b, F.date_trunc("day", "ts"), {"prior_day_high": F.max("high")})
    return prior_period(b, F.date_trunc("week", "ts"), {"prior_week_low": F.min("low")})


@query("jn25_static_map", KEY + "spread threshold", """SELECT symbol, bar_idx, CASE session_regime WHEN 'asia' THEN 1.2 WHEN 'london' THEN 0.8 WHEN 'overlap' THEN 0.6 WHEN 'new_york' THEN 0.9 ELSE 1.5 END AS spread,
 CASE session_regime WHEN 'london' THEN 0.55 WHEN 'overlap' THEN 0.6 ELSE 0.5 END AS threshold FROM sess""")
def _(m):
    sp = m.spark.createDataFrame([("asia", 1.2), ("london", 0.8), ("overlap", 0.6), ("new_york", 0.9), ("off_hours", 1.5)], "session_regime string, spread double")
    th = m.spark.createDataFrame([("london", 0.55), ("overlap", 0.6)], "session_regime string, thr double")
    d = ff.session(m.bars()).join(F.broadcast(sp), "session_regime", "left").join(F.broadcast(th), "session_regime", "left")
    return d.withColumn("threshold", F.coalesce("thr", F.lit(0.5)))


@query("jn26_tolerant_compare", "feature:s compared:l matched:l only_left:l only_right:l max_abs_diff", """SELECT feature, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared,
 count(*) FILTER ((a IS NULL AND b IS NULL AND lk AND rk) OR abs(a - b) <= 1e-6 + 1e-4 * abs(b)) AS matched, count(*) FILTER (lk AND NOT rk) AS only_left,
 count(*) FILTER (rk AND NOT lk) AS only_right, max(abs(a - b)) AS max_abs_diff FROM (
 SELECT unnest(['close', 'volume']) AS feature, unnest([l.close, l.volume]) AS a, unnest([r.close, r.volume]) AS b, l.symbol IS NOT NULL AS lk, r.symbol IS NOT NULL AS rk
 FROM (SELECT * FROM bars WHERE bar_idx % 17 <> 0) l FULL JOIN (SELECT symbol, bar_idx, CASE WHEN bar_idx % 10 = 0 THEN close + 0.5 ELSE close END AS close, volume FROM bars WHERE bar_idx % 19 <> 0) r
 ON l.symbol = r.symbol AND l.bar_idx = r.bar_idx) GROUP BY 1""")
def _(m):
    from barloom.operators.provenance import compare_summary, tolerant_compare
    b = m.bars()
    other = b.filter("bar_idx % 19 <> 0").withColumn("close", F.when(c("bar_idx") % 10 == 0, c("close") + 0.5).otherwise(c("close")))
    return compare_summary(tolerant_compare(b.filter("bar_idx % 17 <> 0"), other, ["symbol", "bar_idx"], ["close", "volume"], 1e-6, 1e-4))


@query("jn29_market_feature_alignment", KEY + "close rolling_vol_20", "SELECT * FROM vol")
def _(m):
    f = blocked(m.bars(), ff.volatility, before=61).select("symbol", "bar_idx", "rolling_vol_20")
    return m.bars().join(f, ["symbol", "bar_idx"])


# ---- sorts, limits, sets ----------------------------------------------------------------------------------------------------
@query("st01_stable_sort", "symbol:s bar_idx:l ts:t", "SELECT * FROM bars")
def _(m):
    return m.bars().orderBy("ts", "symbol", "bar_idx")


@query("st02_latest_n", "symbol:s bar_idx:l close", "SELECT * FROM (SELECT * FROM bars ORDER BY ts DESC, symbol DESC LIMIT 50)")
def _(m):
    return m.bars().orderBy(F.desc("ts"), F.desc("symbol")).limit(50).orderBy("ts", "symbol")


@query("st03_top_k_per_group", "symbol:s bar_idx:l move rk:l", "SELECT *, abs(close - open) AS move, row_number() OVER (PARTITION BY symbol ORDER BY abs(close - open) DESC, bar_idx) AS rk FROM bars QUALIFY rk <= 5")
def _(m):
    from barloom.operators.select import top_k
    return top_k(m.bars().withColumn("move", F.abs(c("close") - c("open"))), ["symbol"], [F.desc("move"), F.asc("bar_idx")], 5, "rk")


@query("st04_tuple_argmax", "symbol:s bar_idx:l close", "SELECT symbol, arg_max(bar_idx, (volume, high - low, -bar_idx)) AS bar_idx, arg_max(close, (volume, high - low, -bar_idx)) AS close FROM bars GROUP BY 1")
def _(m):
    k = F.struct("volume", c("high") - c("low"), -c("bar_idx"))
    return m.bars().groupBy("symbol").agg(F.max_by("bar_idx", k).alias("bar_idx"), F.max_by("close", k).alias("close"))


@query("st05_union", "family:s symbol:s bar_idx:l", "SELECT 'up' AS family, symbol, bar_idx FROM bars WHERE close > open UNION ALL SELECT 'busy', symbol, bar_idx FROM bars WHERE volume >= 5")
def _(m):
    b = m.bars()
    return b.filter("close > open").withColumn("family", F.lit("up")).unionByName(b.filter("volume >= 5").withColumn("family", F.lit("busy")))


@query("st06_dedupe_keep_last", "symbol:s ts:t price", "SELECT symbol, date_trunc('hour', ts) AS ts, price, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('hour', ticks.ts) ORDER BY seq DESC) = 1")
def _(m):
    return m.ticks.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("price", "seq").alias("price"))


@query("st07_key_sets", "part:s n:l", """WITH a AS (SELECT symbol, bar_idx FROM bars WHERE close > open), b AS (SELECT symbol, bar_idx FROM bars WHERE volume >= 4)
 SELECT 'shared' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
 UNION ALL SELECT 'rejected', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(m):
    a, b = (m.bars().filter(x).select("symbol", "bar_idx") for x in ("close > open", "volume >= 4"))
    n = lambda d, p: d.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(p))
    return n(a.intersect(b), "shared").unionByName(n(b.subtract(a), "added")).unionByName(n(a.subtract(b), "rejected"))


@query("st08_date_spine", "symbol:s slot:t filled:l", f"""SELECT s.symbol, s.slot, CASE WHEN b.ts IS NULL THEN 0 ELSE 1 END AS filled FROM (
 SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS slot FROM bars GROUP BY symbol) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = s.slot""")
def _(m):
    from barloom.operators.select import spine
    b = m.bars()
    return spine(b, 3600).join(b.select("symbol", c("ts").alias("slot"), F.lit(1).alias("hit")), ["symbol", "slot"], "left").withColumn("filled", flag(c("hit") == 1))


# ---- scalar functions -------------------------------------------------------------------------------------------------------
@query("sc01_timezones", KEY + "ny:t london:t est:t back:t", f"""SELECT symbol, bar_idx, {NYSQL} AS ny, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS london, ts - INTERVAL 5 HOUR AS est, ts AS back FROM bars""")
def _(m):
    ny = clock.local("ts")
    return m.bars().withColumns({"ny": ny, "london": clock.local("ts", clock.LONDON), "est": clock.local("ts", "-05:00"), "back": F.to_utc_timestamp(ny, clock.NY)})


@query("sc02_session_regime", KEY + "session_regime:s", "SELECT * FROM sess")
def _(m):
    return m.bars().withColumns(clock.sessions())


@query("sc03_market_day_close", KEY + "close_ts:t", f"SELECT *, {DAYCLOSE} AS close_ts FROM bars")
def _(m):
    return m.bars().withColumn("close_ts", clock.day_close())


@query("sc04_market_week_close", KEY + "close_ts:t", f"SELECT *, {WEEKCLOSE} AS close_ts FROM bars")
def _(m):
    return m.bars().withColumn("close_ts", clock.week_close())


@query("sc05_calendar_rules", "d:s third_friday:s quarter_end:s thanksgiving:s memorial:s easter:s", """SELECT d, CAST(date_trunc('month', d) + ((5 - isodow(date_trunc('month', d)) + 7) % 7 + 14) * INTERVAL 1 DAY AS DATE) AS third_friday,
 CAST(q - greatest(isodow(q) - 5, 0) * INTERVAL 1 DAY AS DATE) AS quarter_end, CAST(n1 + ((4 - isodow(n1) + 7) % 7 + 21) * INTERVAL 1 DAY AS DATE) AS thanksgiving,
 CAST(m31 - (isodow(m31) - 1) * INTERVAL 1 DAY AS DATE) AS memorial, e.easter FROM (
 SELECT DISTINCT CAST(ts AS DATE) AS d, last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTH AS DATE)) AS q, make_date(year(ts), 11, 1) AS n1, make_date(year(ts), 5, 31) AS m31, year(ts) AS y FROM daily)
 LEFT JOIN (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15')) e(y, easter) USING (y)""")
def _(m):
    d, y = c("d"), F.year("d")
    return m.daily().select(F.to_date("ts").alias("d")).distinct().withColumns({
        "third_friday": clock.third_friday(d), "quarter_end": clock.last_business_day_of_quarter(d), "thanksgiving": clock.nth_weekday(y, 11, "THU", 4),
        "memorial": clock.last_weekday(y, 5, "MON"), "easter": clock.easter(y)})


@query("sc06_math", KEY + "lp sq hs tick_up tick_down clipped sg:l", "SELECT *, ln(1 + volume) AS lp, sqrt(close) AS sq, sin(2 * pi() * hour(ts) / 24) AS hs, ceil(close / 0.25 - 1e-9) * 0.25 AS tick_up, floor(close / 0.25 + 1e-9) * 0.25 AS tick_down, least(greatest(close, 10), 100) AS clipped, sign(close - open) AS sg FROM bars")
def _(m):
    from barloom.operators.outcomes import tick_down, tick_up
    return m.bars().withColumns({"lp": F.log1p("volume"), "sq": F.sqrt("close"), "hs": F.sin(2 * F.pi() * F.hour("ts") / 24), "tick_up": tick_up(c("close"), 0.25),
                                 "tick_down": tick_down(c("close"), 0.25), "clipped": cols.clip("close", 10.0, 100.0), "sg": F.signum(c("close") - c("open"))})


@query("sc07_strings", "p_partkey:l slug:s side:s asset:s", r"""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_extract(p_type, '^([A-Z]+)', 1) AS side, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS asset FROM part""")
def _(m):
    from barloom.functions.text import asset_symbol, slug
    return m.table("part").select("p_partkey", slug("p_name").alias("slug"), F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("side"), asset_symbol("p_brand").alias("asset"))


@query("sc08_contract_symbols", "d:s contract:s expiry:s", """SELECT DISTINCT CAST(ts AS DATE) AS d, 'ES' || CASE q WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || (year(ts) % 100 // 10) || (year(ts) % 10) AS contract,
 CAST(f + ((5 - isodow(f) + 7) % 7 + 14) * INTERVAL 1 DAY AS DATE) AS expiry FROM (SELECT ts, CAST(ceil(month(ts) / 3.0) * 3 AS INTEGER) AS q, make_date(year(ts), CAST(ceil(month(ts) / 3.0) * 3 AS INTEGER), 1) AS f FROM daily)""")
def _(m):
    from barloom.functions.text import quarterly_contract
    sym, exp = quarterly_contract(c("d"), "ES")
    return m.daily().select(F.to_date("ts").alias("d")).distinct().withColumns({"contract": sym, "expiry": exp})


@query("sc09_json", "event_id:l k:l payload_close", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS payload_close FROM events")
def _(m):
    e = m.table("events").withColumn("p", F.from_json("props", "k LONG")).withColumn("j", F.to_json(F.struct(c("value").alias("close"))))
    return e.select("event_id", c("p.k").alias("k"), F.get_json_object("j", "$.close").cast("double").alias("payload_close"))


@query("sc10_arrays", KEY + "near above_d below_d within_n:l overlap", """SELECT symbol, bar_idx, close - arg_min(l, (abs(close - l), l * -1)) AS near, min(CASE WHEN l > close THEN l - close END) AS above_d, min(CASE WHEN l < close THEN close - l END) AS below_d,
 count(CASE WHEN abs(l - close) <= 5 THEN 1 END) AS within_n, any_value(CASE WHEN least(high - low, 20) > 0 THEN greatest(least(high, 60.0) - greatest(low, 40.0), 0) / least(high - low, 20) ELSE 0 END) AS overlap
 FROM bars CROSS JOIN (VALUES (5.0), (20.0), (55.5), (120.0), (300.0)) t(l) GROUP BY symbol, bar_idx, close""")
def _(m):
    lv = F.array(*[F.lit(x) for x in (5.0, 20.0, 55.5, 120.0, 300.0)])
    p = c("close")
    return m.bars().withColumns({"near": cols.nearest(lv, p), "above_d": cols.above(lv, p), "below_d": cols.below(lv, p), "within_n": cols.within_count(lv, p, F.lit(5.0)),
                                 "overlap": cols.overlap_share("low", "high", F.lit(40.0), F.lit(60.0))})


@query("sc11_content_hash", KEY + "h:s", """SELECT *, sha256('{"close":"' || CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR) || '","symbol":"' || symbol || '"}') AS h FROM bars""")
def _(m):
    from barloom.functions.text import content_hash
    return m.bars().withColumn("h", content_hash({"symbol": c("symbol"), "close": F.round(c("close") * 100).cast("long").cast("string")}))


@query("sc12_timeframe_floor", "event_id:l m1:t m5:t m30:t h1:t", "SELECT event_id, time_bucket(INTERVAL 1 MINUTE, ts) AS m1, time_bucket(INTERVAL 5 MINUTE, ts) AS m5, time_bucket(INTERVAL 30 MINUTE, ts) AS m30, date_trunc('hour', ts) AS h1 FROM events")
def _(m):
    return m.table("events").select("event_id", *[clock.floor_to("ts", s).alias(n) for n, s in (("m1", 60), ("m5", 300), ("m30", 1800), ("h1", 3600))])


@query("sc13_quality_curves", KEY + "dq px bc", "SELECT *, CASE WHEN x <= 0 THEN 0.0 WHEN x < 0.15 THEN x / 0.15 WHEN x <= 0.65 THEN 1.0 WHEN x <= 1 THEN 1 - (x - 0.65) / 0.35 ELSE 0.0 END AS dq, 1.0 - least(greatest(close / 100, 0), 2) / 2 AS px, least(greatest(close / 300, 0), 1) AS bc FROM (SELECT *, close / 400 AS x FROM bars)")
def _(m):
    return m.bars().withColumns({"dq": cols.depth_quality(c("close") / 400), "px": cols.proximity(c("close") / 100), "bc": cols.bounded(c("close") / 300)})


@query("sc14_session_phase", KEY + "phase:l", f"""SELECT *, CASE WHEN x < 570 OR x >= 960 THEN 1 WHEN x < 630 THEN 2 WHEN x < 720 THEN 3 WHEN x < 810 THEN 4 WHEN x < 870 THEN 3 ELSE 5 END AS phase FROM (SELECT *, {_MIN} AS x FROM bars)""")
def _(m):
    from barloom.operators.calendars import session_phase
    return m.bars().withColumn("phase", session_phase("ts"))

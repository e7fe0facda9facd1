"""Continuity (DT19-DT22, AG05, AG06, JN08, JN10, WN32, WN33) and volume profiles (AG07-AG12, DT10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators import calendars as cal
from barloom.operators import futures as fu
from barloom.operators import patterns as pt
from barloom.plans.base import DAYCLOSE, NYSQL
from barloom.plans.detect import session_eq_sql
from barloom.plans.registry import S, query, s_flag, shared

shared("sv", f"SELECT symbol, {DAYCLOSE} AS session_close, contract_id, sum(volume) AS metric, min(ts) AS session_start, max(ts) AS session_end, count(*) AS bars FROM cbars GROUP BY 1, 2, 3")


def sessions(m):
    return m.stage("sessions", lambda: fu.session_volume(m.contract_bars()))


@query("ag05_session_volume", "symbol:s session_close:t contract_id:s metric session_start:t session_end:t bars:l", "SELECT * FROM sv")
def _(m):
    return sessions(m)


WIN = """WITH RECURSIVE t AS MATERIALIZED (SELECT symbol, session_close, metric AS top, list_sort(list(contract_id)) AS ids, row_number() OVER (PARTITION BY symbol ORDER BY session_close) AS rn FROM sv
 WHERE metric = (SELECT max(metric) FROM sv s2 WHERE s2.symbol = sv.symbol AND s2.session_close = sv.session_close) GROUP BY 1, 2, 3), r AS (SELECT symbol, session_close, top, rn, ids[1] AS winner FROM t WHERE rn = 1
 UNION ALL SELECT t.symbol, t.session_close, t.top, t.rn, CASE WHEN list_contains(t.ids, r.winner) THEN r.winner ELSE t.ids[1] END FROM r JOIN t ON t.symbol = r.symbol AND t.rn = r.rn + 1) SELECT * FROM r"""
_SC = "PARTITION BY symbol ORDER BY session_close"
ROLL = f"""SELECT *, max(is_roll) OVER ({_SC} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS in_bracket FROM (SELECT *, {s_flag(f"lead_contract <> lag(lead_contract) OVER ({_SC})")} AS is_roll, lag(lead_contract) OVER ({_SC}) AS from_contract FROM (
 SELECT w.*, coalesce(lag(winner) OVER (PARTITION BY w.symbol ORDER BY w.session_close), winner) AS lead_contract, s.session_start FROM ({WIN}) w JOIN (SELECT symbol, session_close, min(session_start) AS session_start FROM sv GROUP BY 1, 2) s ON s.symbol = w.symbol AND s.session_close = w.session_close))"""
shared("roll", ROLL)


def schedule(m):
    return m.stage("roll", lambda: fu.roll_calendar(sessions(m)))


@query("ag06_leader_selection", "symbol:s session_close:t winner:s top", "SELECT * FROM roll")
def _(m):
    return schedule(m)


@query("dt19_roll_calendar", "symbol:s session_close:t lead_contract:s is_roll:l in_bracket:l", "SELECT * FROM roll")
def _(m):
    return schedule(m)


@query("wn32_roll_brackets", "symbol:s session_close:t in_bracket:l", "SELECT * FROM roll")
def _(m):
    return schedule(m)


@query("jn08_lead_contract", "symbol:s contract_id:s ts:t close is_roll:l", f"SELECT b.*, r.is_roll FROM (SELECT *, {DAYCLOSE} AS sc FROM cbars) b JOIN roll r ON r.symbol = b.symbol AND r.session_close = b.sc AND r.lead_contract = b.contract_id")
def _(m):
    return fu.continuous(m.contract_bars(), schedule(m))


REV = f"""SELECT *, sum(roll_spread) OVER ({_SC} ROWS UNBOUNDED PRECEDING) AS cumulative_spread FROM (SELECT r.symbol, r.session_close, r.from_contract, r.lead_contract AS to_contract, min(a.ts) AS spread_ts, arg_min(b.close - a.close, a.ts) AS roll_spread
 FROM roll r JOIN cbars a ON a.symbol = r.symbol AND a.contract_id = r.from_contract AND a.ts >= r.session_start JOIN cbars b ON b.symbol = r.symbol AND b.contract_id = r.lead_contract AND b.ts = a.ts WHERE r.is_roll = 1 GROUP BY 1, 2, 3, 4)"""


def rolls(m):
    return m.stage("roll_events", lambda: fu.roll_events(m.contract_bars(), schedule(m)))


@query("jn10_first_common_timestamp", "symbol:s session_close:t from_contract:s to_contract:s spread_ts:t roll_spread", REV)
def _(m):
    return rolls(m)


@query("wn33_cumulative_roll_spread", "symbol:s session_close:t cumulative_spread", REV)
def _(m):
    return rolls(m)


@query("dt21_equity_session_frame", "symbol:s bar_idx:l session_date:s is_rth:l is_overnight:l is_ib:l ib_complete:l minutes_since_open:l minutes_until_close:l",
       f"SELECT *, CASE WHEN is_rth THEN mloc - 570 END AS minutes_since_open, CASE WHEN is_rth THEN 960 - mloc END AS minutes_until_close FROM ({session_eq_sql('fine')})")
def _(m):
    return cal.equity_session(m.bars(900))


# Dated releases used by the macro calendar query.
RELEASES = [("cpi", "2024-01-11"), ("fomc", "2024-01-31"), ("statement", "2024-01-31"), ("presser", "2024-01-31")]
_LM = f"hour({NYSQL}) * 60 + minute({NYSQL})"
_LD = f"CAST({NYSQL} AS DATE)"


@query("dt22_macro_event_flags", "symbol:s bar_idx:l cpi_flag:l nfp_flag:l fomc_flag:l macro_event_flag:l", f"""SELECT *, greatest(cpi_flag, nfp_flag, fomc_flag) AS macro_event_flag FROM (SELECT symbol, bar_idx, {s_flag(f"{_LD} = DATE '2024-01-11' AND {_LM} BETWEEN 495 AND 540")} AS cpi_flag,
 {s_flag(f"{_LD} = DATE '2024-01-05' AND {_LM} BETWEEN 495 AND 540")} AS nfp_flag, {s_flag(f"{_LD} = DATE '2024-01-31' AND {_LM} BETWEEN 825 AND 915")} AS fomc_flag FROM fine)""")
def _(m):
    rel = m.spark.createDataFrame(RELEASES, "kind string, d string").select("kind", F.to_date("d").alias("day"))
    return cal.macro_flags(m.bars(900), rel)


# ---- profiles ---------------------------------------------------------------------------------------------------------------
_PD = "PARTITION BY symbol, day ORDER BY ts"
shared("hist", f"""SELECT *, bin * bin_width AS price FROM (SELECT symbol, day, bin, bin_width, sum(CASE WHEN high > low THEN volume * greatest(least(high, (bin + 1) * bin_width) - greatest(low, bin * bin_width), 0) / (high - low) ELSE volume END) AS volume FROM (
 SELECT *, unnest(range(CAST(floor(low / bin_width) AS BIGINT), CAST(floor(high / bin_width) AS BIGINT) + 1)) AS bin FROM (SELECT d.*, greatest(CASE WHEN n >= 14 AND last14 > 0 THEN last14 ELSE alltr END / 20.0, 0.25) AS bin_width FROM (SELECT *, CAST(ts AS DATE) AS day FROM bars) d JOIN (
 SELECT symbol, day, count(*) AS n, avg(tr) FILTER (back <= 14) AS last14, avg(tr) AS alltr FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts DESC) AS back, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (
 SELECT *, CAST(ts AS DATE) AS day, lag(close) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS pc FROM bars)) GROUP BY 1, 2) w USING (symbol, day))) GROUP BY 1, 2, 3, 4) WHERE volume > 1e-12""")


def hist(m):
    return m.stage("hist", lambda: fu.profile(m.bars().withColumn("day", F.to_date("ts")), ["symbol", "day"]))


@query("ag07_volume_profile", "symbol:s day:s bin:l price:d8 volume:d5", "SELECT * FROM hist")
def _(m):
    return hist(m)


_PV = "PARTITION BY symbol, day ORDER BY round(volume, 9) DESC, price"
shared("prof", f"""SELECT *, CASE WHEN bottom_share > 0.35 AND skew > 0.5 THEN 'P' WHEN top_share > 0.35 AND skew < -0.5 THEN 'b' ELSE 'D' END AS shape FROM (SELECT symbol, day, arg_max(price, (round(volume, 9), -price)) AS poc, max(price) FILTER (inn) AS vah, min(price) FILTER (inn) AS val,
 sum(volume) AS total_volume, count(*) FILTER (round(volume - m - 0.5 * s, 9) >= 0) AS hvn_count, count(*) FILTER (round(volume - m + 0.5 * s, 9) <= 0) AS lvn_count, sum(volume) FILTER (price >= hi - 0.25 * (hi - lo)) / sum(volume) AS top_share,
 sum(volume) FILTER (price <= lo + 0.25 * (hi - lo)) / sum(volume) AS bottom_share, max(volume) / sum(volume) AS poc_share,
 CASE WHEN sum(volume * (price - mu) ^ 2) / sum(volume) > 1e-12 THEN (sum(volume * (price - mu) ^ 3) / sum(volume)) / (sum(volume * (price - mu) ^ 2) / sum(volume)) ^ 1.5 ELSE 0 END AS skew FROM (
 SELECT *, rk = 1 OR cum <= 0.7 * tot + 1e-9 OR (coalesce(lag(cum) OVER ({_PV}), 0) < 0.7 * tot - 1e-9 AND cum > 0.7 * tot) AS inn FROM (SELECT *, sum(volume) OVER (p) AS tot, sum(volume) OVER ({_PV} ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER ({_PV}) AS rk,
 avg(volume) OVER (p) AS m, stddev_pop(volume) OVER (p) AS s, min(price) OVER (p) AS lo, max(price) OVER (p) AS hi, sum(volume * price) OVER (p) / sum(volume) OVER (p) AS mu FROM hist WINDOW p AS (PARTITION BY symbol, day))) GROUP BY 1, 2)""".replace("OVER (p)", "OVER p"))


def prof(m):
    return m.stage("prof", lambda: fu.profile_levels(hist(m), ["symbol", "day"]))


for _n, _o in (("ag08_poc", "poc:d8 total_volume:d5"), ("ag09_value_area", "vah:d8 val:d8"), ("ag10_volume_nodes", "hvn_count:l lvn_count:l"), ("ag11_profile_shape", "skew:d4 top_share:d5 bottom_share:d5 poc_share:d5 shape:s")):
    query(_n, "symbol:s day:s " + _o, "SELECT * FROM prof")(prof)


@query("dt10_naked_poc", "symbol:s born:s poc:d8 touched_idx:l", """SELECT p.symbol, p.day AS born, p.poc, min(b.bar_idx) AS touched_idx FROM prof p LEFT JOIN bars b ON b.symbol = p.symbol AND CAST(b.ts AS DATE) > p.day AND p.poc BETWEEN b.low AND b.high GROUP BY 1, 2, 3""")
def _(m):
    return fu.naked_levels(prof(m).select("symbol", c("day").alias("born"), "poc"), m.bars())


@query("ag12_session_summary", "symbol:s session_date:s rth_bars:l rth_volume thin:l", f"""SELECT *, {s_flag('rth_volume < 0.6 * med')} AS thin FROM (SELECT *, quantile_cont(rth_volume, 0.5) OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS med FROM (
 SELECT symbol, session_date, count(*) AS rth_bars, sum(volume) AS rth_volume FROM ({session_eq_sql('fine')}) WHERE is_rth GROUP BY 1, 2))""")
def _(m):
    from pyspark.sql import Window
    d = cal.equity_session(m.bars(900)).filter("is_rth").groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("rth_bars"), F.sum("volume").alias("rth_volume"))
    w = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(-10, -1)
    return d.withColumn("thin", flag(c("rth_volume") < 0.6 * F.percentile("rth_volume", 0.5).over(w)))


for _n, _o, in (("wn18_session_extremes", "overnight_high overnight_low ib_high ib_low ib_high_developing ib_low_developing"), ("wn19_session_vwap", "session_vwap:d8 rth_vwap:d8")):
    from barloom.plans.detect import ref_sql
    query(_n, "symbol:s bar_idx:l " + _o, f"SELECT * FROM ({ref_sql('fine')})")(lambda m: pt.reference_levels(m.bars(900)))

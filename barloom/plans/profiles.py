"""DT09 anchors, AG13-AG15 session tables, FF19 profile context in full and the profile setups DT11, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators import calendars as cal
from barloom.operators import features as ff
from barloom.operators import futures as fu
from barloom.operators import profiles as pf
from barloom.operators.blocks import blocked
from barloom.operators.relate import asof
from barloom.plans import futures  # noqa: F401 - names the profile texts
from barloom.plans.detect import BLOCK_SQL, GAP_SQL, context_t, session_eq_sql
from barloom.plans.registry import SHARED, query, s_div, s_flag, shared

KEY = "symbol:s bar_idx:l "
DRIVE_MINUTES, DRIVE_BARS = 120, 2  #: hourly bars
ZONES = [f"dist_to_{s}_{z}_atr" for s in ("bull", "bear") for z in ("fvg", "order_block")]


def bars_t(m):
    def build():
        d = ff.structure_ages(blocked(m.bars(), lambda d, w: ff.volume(ff.structure(ff.volatility(d, w), w), w), before=122))
        d = cal.equity_session(ff.session(d)).select("symbol", "bar_idx", "ts", "open", "high", "low", "close", "volume", "atr_14", "volume_zscore_50", "displacement_bullish", "displacement_bearish", "bars_since_sweep_high",
                                                    "bars_since_sweep_low", "in_london_killzone", "in_newyork_killzone", "session_date", "is_rth", "is_overnight", "is_ib", "ib_complete", "minutes_since_open")
        return d.join(context_t(m).select("symbol", "bar_idx", "confirmed_swing_high", "confirmed_swing_low", *ZONES), ["symbol", "bar_idx"])
    return m.stage("profile_bars", build)


def plain_sessions_t(m):
    return m.stage("profile_sessions", lambda: pf.session_table(bars_t(m), DRIVE_MINUTES, DRIVE_BARS))


def swings_t(m):
    return m.stage("profile_swings", lambda: pf.swing_windows(bars_t(m)))


def levels_t(m):
    return m.stage("profile_levels", lambda: fu.profile_levels(fu.profile(pf.anchor_bars(bars_t(m), plain_sessions_t(m), swings_t(m)), ["symbol", "anchor", "key"]), ["symbol", "anchor", "key"]))


def sessions_t(m):
    def build():
        rth = levels_t(m).filter("anchor = 'prior_rth'").select("symbol", F.to_date("key").alias("session_date"), "poc", "vah", "val", "shape")
        return pf.history(pf.day_types(plain_sessions_t(m), rth)).drop("poc", "vah", "val", "shape")
    return m.stage("profile_history", build)


def anchored_t(m):
    return m.stage("profile_anchored", lambda: pf.anchored(bars_t(m), sessions_t(m), levels_t(m), swings_t(m)))


def naked_t(m):
    def build():
        d = anchored_t(m)
        levels = levels_t(m).select("symbol", "anchor", F.to_date("key").alias("day"), c("poc").alias("price")).filter("anchor IN ('prior_rth', 'overnight', 'initial_balance')")
        # an anchor is born at the first bar that sees it
        ends = levels.withColumn("_at", F.when(c("anchor") == "prior_rth", pf.local_clock(c("day"), 960)).when(c("anchor") == "overnight", pf.local_clock(c("day"), 570)))
        born = []
        for a in ("prior_rth", "overnight"):
            x = asof(d.select("symbol", "bar_idx", "ts"), ends.filter(c("anchor") == a), "ts", "_at", ["day", "price"], strict=True).filter("day IS NOT NULL")
            born.append(x.groupBy("symbol", "day", "price").agg(F.min("bar_idx").alias("born_idx")).withColumn("anchor", F.lit(a)))
        ib = d.filter("ib.poc IS NOT NULL").groupBy("symbol", c("session_date").alias("day"), c("ib.poc").alias("price")).agg(F.min("bar_idx").alias("born_idx")).withColumn("anchor", F.lit("initial_balance"))
        every = born[0].unionByName(born[1]).unionByName(ib)
        every = every.join(plain_sessions_t(m).select("symbol", c("session_date").alias("day"), "session_no"), ["symbol", "day"], "left")
        return pf.first_touch(every, d.select("symbol", "bar_idx", "low", "high"))
    return m.stage("profile_naked", build)


def context_fields_t(m):
    return m.stage("profile_context", lambda: pf.context(pf.naked_context(anchored_t(m), naked_t(m))))


# ---- twins --------------------------------------------------------------------------------------------------------------------
shared("pb", session_eq_sql("(SELECT s.*, v.volume_zscore_50, e.in_london_killzone, e.in_newyork_killzone FROM struc s JOIN volu v USING (symbol, bar_idx) JOIN sess e USING (symbol, bar_idx))"))
_D = "PARTITION BY symbol ORDER BY session_date"
_UPS = "len(list_filter(range(2, len(e) + 1), lambda i: e[i].c < e[i - 1].c)) = 0"
shared("ps", f"""SELECT *, CASE WHEN len(e) >= {DRIVE_BARS} THEN {s_flag(f"(list_min(list_transform(e, lambda x: x.l)) >= rth_open AND e[len(e)].c > rth_open AND {_UPS}) OR (list_max(list_transform(e, lambda x: x.h)) <= rth_open AND e[len(e)].c < rth_open AND {_UPS.replace('<', '>')})")} END AS open_drive,
 row_number() OVER ({_D}) AS session_no, CASE WHEN rth_open IS NOT NULL THEN count(rth_open) OVER ({_D}) END AS rth_no FROM (SELECT symbol, session_date, min(ts) FILTER (is_rth) AS rth_open_ts, arg_min(open, ts) FILTER (is_rth) AS rth_open, arg_max(close, ts) FILTER (is_rth) AS rth_close,
 max(high) FILTER (is_rth) AS rth_high, min(low) FILTER (is_rth) AS rth_low, arg_max(atr_14, ts) FILTER (is_rth AND atr_14 IS NOT NULL) AS rth_atr0, max(high) FILTER (is_ib) AS ib_high, min(low) FILTER (is_ib) AS ib_low,
 coalesce(list({{'t': ts, 'l': low, 'h': high, 'c': close}} ORDER BY ts) FILTER (is_rth AND mloc - 570 < {DRIVE_MINUTES}), []) AS e, max({{'t': ts, 'a': atr_14}}) FILTER (is_rth) AS ra FROM pb GROUP BY 1, 2)""".replace("arg_max(atr_14, ts) FILTER (is_rth AND atr_14 IS NOT NULL) AS rth_atr0, ", "").replace("FROM (SELECT symbol, session_date, min(ts)", "FROM (SELECT *, ra.a AS rth_atr FROM (SELECT symbol, session_date, min(ts)") + ")")
shared("pw", """SELECT symbol, bar_idx, arg_max(prev_idx, o) AS prev_idx, arg_max(swing_idx, o) AS swing_idx FROM (SELECT *, lag(swing_idx) OVER (PARTITION BY symbol ORDER BY o) AS prev_idx FROM (
 SELECT symbol, bar_idx, bar_idx * 2 AS o, bar_idx - 3 AS swing_idx FROM pt_sw WHERE confirmed_swing_high = 1 UNION ALL SELECT symbol, bar_idx, bar_idx * 2 + 1, bar_idx - 3 FROM pt_sw WHERE confirmed_swing_low = 1)) GROUP BY 1, 2""")
_AB = "ts, open, high, low, close, volume"
shared("pa_bars", f"""SELECT symbol, 'prior_rth|' || session_date AS day, {_AB} FROM pb WHERE is_rth UNION ALL SELECT symbol, 'overnight|' || session_date, {_AB} FROM pb WHERE is_overnight UNION ALL SELECT symbol, 'initial_balance|' || session_date, {_AB} FROM pb WHERE is_ib
 UNION ALL SELECT b.symbol, 'composite|' || z.session_date, {', '.join('b.' + x for x in _AB.split(', '))} FROM pb b JOIN ps s ON s.symbol = b.symbol AND s.session_date = b.session_date JOIN ps z ON z.symbol = b.symbol AND z.rth_no BETWEEN s.rth_no AND s.rth_no + {pf.COMPOSITE - 1} WHERE b.is_rth
 UNION ALL SELECT b.symbol, 'swing|' || w.bar_idx, {', '.join('b.' + x for x in _AB.split(', '))} FROM pw w JOIN pb b ON b.symbol = w.symbol AND b.bar_idx BETWEEN w.prev_idx AND w.swing_idx WHERE w.prev_idx < w.swing_idx""")
_hist = SHARED["hist"].replace("lag(close) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)", "lag(close) OVER (PARTITION BY symbol, day ORDER BY ts)").replace("SELECT *, CAST(ts AS DATE) AS day, ", "SELECT *, ").replace("SELECT *, CAST(ts AS DATE) AS day FROM bars", "SELECT * FROM pa_bars").replace("FROM bars", "FROM pa_bars")
shared("pa_hist", _hist)
_prof = SHARED["prof"].replace("FROM hist", "FROM pa_hist").replace("AS hvn_count,", "AS hvn_count, coalesce(list(price ORDER BY price) FILTER (round(volume - m - 0.5 * s, 9) >= 0), []) AS hvn, coalesce(list(price ORDER BY price) FILTER (round(volume - m + 0.5 * s, 9) <= 0), []) AS lvn,")
shared("pa_prof", f"SELECT *, split_part(day, '|', 1) AS anchor, split_part(day, '|', 2) AS key FROM ({_prof})")
_RNG, _IB = "(rth_high - rth_low)", "greatest(ib_high - ib_low, 1e-8)"
_POS = f"(rth_close - rth_low) / {_RNG}"
_OU, _OD = f"(rth_close > rth_open AND {_POS} >= 0.75 AND NOT rth_low < ib_low)", f"(rth_close < rth_open AND {_POS} <= 0.25 AND NOT rth_high > ib_high)"
_H = f"{_D} ROWS BETWEEN {pf.HISTORY} PRECEDING AND 1 PRECEDING"
shared("psx", f"""SELECT *, CASE WHEN count(wa) OVER ({_H}) >= 2 AND stddev_pop(wa) OVER ({_H}) <> 0 THEN (wa - avg(wa) OVER ({_H})) / stddev_pop(wa) OVER ({_H}) END AS width_z, quantile_cont(va_width, 0.5) OVER ({_H}) AS width_median, lag(poc) OVER ({_D}) AS previous_poc, lag(va_mid) OVER ({_D}) AS previous_mid FROM (
 SELECT s.*, p.poc, p.vah, p.val, p.shape, vah - val AS va_width, {s_div('vah - val', 'rth_atr')} AS wa, (vah + val) / 2.0 AS va_mid, CASE WHEN NOT {_RNG} > 0 OR ib_high IS NULL THEN 0
 WHEN {_RNG} >= 1.8 * {_IB} AND ((shape = 'P' AND {_OU}) OR (shape = 'b' AND {_OD})) AND (rth_close > vah OR rth_close < val) THEN 4 WHEN {_RNG} >= 1.8 * {_IB} AND ((rth_close > vah AND {_OU}) OR (rth_close < val AND {_OD})) THEN 3
 WHEN rth_high > ib_high AND rth_low < ib_low THEN 5 WHEN {_RNG} >= 1.25 * {_IB} AND (rth_high > ib_high OR rth_low < ib_low) THEN 2 ELSE 1 END AS day_type FROM ps s JOIN pa_prof p ON p.symbol = s.symbol AND p.anchor = 'prior_rth' AND p.key = CAST(s.session_date AS VARCHAR))""")
_AT = lambda mins: f"(CAST(key AS DATE) + INTERVAL {mins} MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'"
_LV = "poc, vah, val, hvn, lvn, shape, skew, top_share, bottom_share, poc_share"
_pk = lambda p, cols=_LV: ", ".join(f"{p}.{x} AS {p}_{x}" for x in cols.split(", "))
shared("pan", f"""SELECT b.*, {_pk('rth', _LV + ', day_type, width_z, width_median, previous_poc, previous_mid, va_width')}, {_pk('onn')}, cp.poc AS cp_poc, CASE WHEN b.is_rth AND b.ib_complete THEN ib.poc END AS ib_poc, sp.poc AS sp_poc, sp.vah AS sp_vah, sp.val AS sp_val, sp.px AS sp_close,
 z.session_no, z.rth_open_ts, z.rth_open, z.open_drive, z.ib_high AS s_ib_high, z.ib_low AS s_ib_low, sw.poc AS sw_poc FROM pb b
 ASOF LEFT JOIN (SELECT p.*, {_AT(960)} AS at_, x.day_type, x.width_z, x.width_median, x.previous_poc, x.previous_mid, x.va_width FROM pa_prof p JOIN psx x ON x.symbol = p.symbol AND CAST(x.session_date AS VARCHAR) = p.key WHERE anchor = 'prior_rth') rth ON rth.symbol = b.symbol AND b.ts > rth.at_
 ASOF LEFT JOIN (SELECT *, {_AT(570)} AS at_ FROM pa_prof WHERE anchor = 'overnight') onn ON onn.symbol = b.symbol AND b.ts > onn.at_
 ASOF LEFT JOIN (SELECT *, {_AT(960)} AS at_ FROM pa_prof WHERE anchor = 'composite') cp ON cp.symbol = b.symbol AND b.ts > cp.at_
 LEFT JOIN (SELECT * FROM pa_prof WHERE anchor = 'initial_balance') ib ON ib.symbol = b.symbol AND ib.key = CAST(b.session_date AS VARCHAR)
 LEFT JOIN (SELECT symbol, session_date, lag(poc) OVER ({_D}) AS poc, lag(vah) OVER ({_D}) AS vah, lag(val) OVER ({_D}) AS val, lag(rth_close) OVER ({_D}) AS px FROM psx) sp ON sp.symbol = b.symbol AND sp.session_date = b.session_date
 LEFT JOIN psx z ON z.symbol = b.symbol AND z.session_date = b.session_date
 ASOF LEFT JOIN (SELECT w.symbol, w.bar_idx, p.poc FROM pw w LEFT JOIN pa_prof p ON p.symbol = w.symbol AND p.anchor = 'swing' AND p.key = CAST(w.bar_idx AS VARCHAR)) sw ON sw.symbol = b.symbol AND b.bar_idx > sw.bar_idx""")
_seen = lambda a, mins: f"SELECT b.symbol, x.key, x.poc AS price, '{a}' AS anchor, min(b.bar_idx) AS born FROM pb b ASOF JOIN (SELECT *, {_AT(mins)} AS at_ FROM pa_prof WHERE anchor = '{a}') x ON x.symbol = b.symbol AND b.ts > x.at_ GROUP BY 1, 2, 3"
shared("pnk", f"""SELECT l.*, s.session_no AS formed_no, (SELECT min(t.bar_idx) FROM pb t WHERE t.symbol = l.symbol AND t.bar_idx >= l.born AND l.price BETWEEN t.low AND t.high) AS dead FROM ({_seen('prior_rth', 960)} UNION ALL {_seen('overnight', 570)}
 UNION ALL SELECT symbol, CAST(session_date AS VARCHAR), ib_poc, 'initial_balance', min(bar_idx) FROM pan WHERE ib_poc IS NOT NULL GROUP BY 1, 2, 3) l LEFT JOIN ps s ON s.symbol = l.symbol AND CAST(s.session_date AS VARCHAR) = l.key""")
_A = lambda x: s_div(x, "atr_14")
_R = lambda x: f"CASE WHEN rth_poc IS NOT NULL THEN {x} END"
_near = lambda xs: _A(f"list_min(list_transform({xs}, lambda p: abs(p - close)))")
_abv, _blw = (lambda xs: _A(f"list_min(list_filter({xs}, lambda p: p > close)) - close")), (lambda xs: _A(f"close - list_max(list_filter({xs}, lambda p: p < close))"))
_cnt = lambda xs: f"CASE WHEN atr_14 > 0 THEN len(list_filter({xs}, lambda p: abs(p - close) <= atr_14)) ELSE 0 END"
_BOTH, _THREE = "rth_poc IS NOT NULL AND onn_poc IS NOT NULL", "rth_poc IS NOT NULL AND onn_poc IS NOT NULL AND sw_poc IS NOT NULL"
_SPAN = "(greatest(rth_vah, onn_vah) - least(rth_val, onn_val))"
_OPEN = lambda x: f"CASE WHEN sp_poc IS NOT NULL AND ts >= rth_open_ts THEN {x} END"
_IBX = lambda x: f"CASE WHEN ib_poc IS NOT NULL THEN {x} END"
FIELDS = {  # name -> (type, SQL)
    "dist_poc_session_atr": ("d5", _R(_A("close - rth_poc"))), "dist_vah_atr": ("d5", _R(_A("rth_vah - close"))), "dist_val_atr": ("d5", _R(_A("close - rth_val"))),
    "price_position_va": ("d5", _R("CASE WHEN rth_vah = rth_val THEN 0.5 ELSE (close - rth_val) / (rth_vah - rth_val) END")), "above_poc": ("l", _R(s_flag("close > rth_poc"))), "in_va": ("l", _R(s_flag("close BETWEEN rth_val AND rth_vah"))),
    "above_vah": ("l", _R(s_flag("close > rth_vah"))), "below_val": ("l", _R(s_flag("close < rth_val"))), "va_overshoot_atr": ("d5", _R(f"CASE WHEN close > rth_vah THEN {_A('close - rth_vah')} WHEN close < rth_val THEN -{_A('rth_val - close')} ELSE 0 END")),
    "profile_shape": ("l", _R("CASE rth_shape WHEN 'P' THEN 1 WHEN 'b' THEN -1 ELSE 0 END")), "vol_skew": ("d4", "rth_skew"), "vol_top_share": ("d5", "rth_top_share"), "vol_bottom_share": ("d5", "rth_bottom_share"), "poc_vol_share": ("d5", "rth_poc_share"),
    "hvn_count": ("l", _R("len(rth_hvn)")), "lvn_count": ("l", _R("len(rth_lvn)")), "hvn_count_1atr": ("l", _R(_cnt("rth_hvn"))), "lvn_count_1atr": ("l", _R(_cnt("rth_lvn"))), "hvn_above_close": ("d5", _abv("rth_hvn")), "hvn_below_close": ("d5", _blw("rth_hvn")),
    "dist_nearest_hvn_atr": ("d5", _near("rth_hvn")), "dist_nearest_lvn_atr": ("d5", _near("rth_lvn")), "dist_lvn_above_atr": ("d5", _abv("rth_lvn")), "dist_lvn_below_atr": ("d5", _blw("rth_lvn")), "va_width_atr": ("d5", _A("rth_vah - rth_val")),
    "va_width_zscore_20": ("d4", "rth_width_z"), "poc_migration_vel": ("d5", _A("rth_poc - rth_previous_poc")), "va_migration_vel": ("d5", _A("(rth_vah + rth_val) / 2.0 - rth_previous_mid")), "va_expansion": ("l", _R(s_flag("rth_va_width > rth_width_median"))),
    "day_type": ("l", "CASE WHEN rth_day_type > 0 THEN rth_day_type END"), "dist_poc_day_atr": ("d5", _A("close - onn_poc")), "dist_poc_swing_atr": ("d5", _A("close - sw_poc")), "poc_anchor_diff_atr": ("d5", f"CASE WHEN {_BOTH} THEN {_A('rth_poc - onn_poc')} END"),
    "va_overlap": ("d5", f"CASE WHEN {_BOTH} THEN CASE WHEN {_SPAN} > 0 THEN greatest(least(rth_vah, onn_vah) - greatest(rth_val, onn_val), 0) / {_SPAN} WHEN rth_val = onn_val AND rth_vah = onn_vah THEN 1 ELSE 0 END END"),
    "swing_poc_vs_session_poc": ("d5", f"CASE WHEN {_THREE} THEN {_A('sw_poc - rth_poc')} END"),
    "multi_poc_cluster": ("l", f"CASE WHEN {_THREE} THEN {s_flag('atr_14 > 0 AND greatest(rth_poc, onn_poc, sw_poc) - least(rth_poc, onn_poc, sw_poc) <= 0.5 * atr_14')} END"), "composite_poc_dist_atr": ("d5", _A("close - cp_poc")),
    "open_type": ("l", _OPEN("CASE WHEN rth_open BETWEEN sp_val AND sp_vah THEN 0 WHEN rth_open > sp_vah THEN 1 ELSE -1 END")), "open_vs_prior_poc_atr": ("d5", _OPEN(_A("rth_open - sp_poc"))), "open_gap_atr": ("d5", _OPEN(_A("rth_open - sp_close"))),
    "gap_into_value": ("l", _OPEN(s_flag("rth_open BETWEEN sp_val AND sp_vah"))), "session_phase": ("l", "CASE WHEN is_rth THEN CASE WHEN mloc < 600 THEN 1 WHEN mloc < 690 THEN 2 WHEN mloc < 810 THEN 3 WHEN mloc < 900 THEN 4 ELSE 5 END END"),
    "open_drive_flag": ("l", "CASE WHEN is_rth THEN open_drive END"), "dist_ib_high_atr": ("d5", _IBX(_A("s_ib_high - close"))), "dist_ib_low_atr": ("d5", _IBX(_A("close - s_ib_low"))),
    "ib_extension": ("l", _IBX("CASE WHEN high > s_ib_high AND low < s_ib_low THEN CASE WHEN close >= (s_ib_high + s_ib_low) / 2.0 THEN 1 ELSE -1 END WHEN high > s_ib_high THEN 1 WHEN low < s_ib_low THEN -1 ELSE 0 END"))}
_NK = lambda x: f"list_min(list_transform({x}, lambda x: {{'far': abs(x.price - close), 'born': x.born, 'price': x.price, 'no': x.formed_no}}))"
_OFA = lambda a: f"list_filter(nk, lambda x: x.anchor = '{a}')"
NAKED = {"naked_dist_above_atr": ("d5", _A("list_min(list_filter(list_transform(nk, lambda x: x.price), lambda p: p > close)) - close")), "naked_dist_below_atr": ("d5", _A("close - list_max(list_filter(list_transform(nk, lambda x: x.price), lambda p: p < close))")),
         "naked_count": ("l", "CASE WHEN atr_14 > 0 THEN len(list_filter(nk, lambda x: abs(x.price - close) <= 3.0 * atr_14)) ELSE 0 END"), "naked_age_sessions": ("l", f"session_no - {_NK('nk')}.no"),
         "naked_session_dist_atr": ("d5", _A(f"close - {_NK(_OFA('prior_rth'))}.price")), "naked_day_dist_atr": ("d5", _A(f"close - {_NK(_OFA('overnight'))}.price"))}
CONF = {"poc_plus_fvg": s_flag("abs(dist_poc_session_atr) <= 0.5 AND (coalesce(abs(dist_to_bull_fvg_atr) <= 0.5, false) OR coalesce(abs(dist_to_bear_fvg_atr) <= 0.5, false))"), "vah_plus_ob": s_flag("abs(dist_vah_atr) <= 0.3 AND abs(dist_to_bear_order_block_atr) <= 0.5"),
        "val_plus_ob": s_flag("abs(dist_val_atr) <= 0.3 AND abs(dist_to_bull_order_block_atr) <= 0.5"), "in_killzone": s_flag("in_london_killzone = 1 OR in_newyork_killzone = 1")}
OUT = " ".join(f"{n}:{t}" for n, (t, _) in (FIELDS | NAKED).items()) + " " + " ".join(f"{n}:l" for n in CONF)
shared("pctx", f"""SELECT *, {', '.join(f'{x} AS {n}' for n, x in CONF.items())} FROM (SELECT p.* EXCLUDE (nk), {', '.join(f'{x} AS {n}' for n, (_, x) in (FIELDS | NAKED).items())}, g.dist_to_bull_fvg_atr, g.dist_to_bear_fvg_atr, k.dist_to_bull_order_block_atr, k.dist_to_bear_order_block_atr FROM (
 SELECT b.*, (SELECT coalesce(list({{'price': n.price, 'born': n.born, 'anchor': n.anchor, 'formed_no': n.formed_no}}), []) FROM pnk n WHERE n.symbol = b.symbol AND n.born <= b.bar_idx AND (n.dead IS NULL OR n.dead > b.bar_idx)) AS nk FROM pan b) p
 JOIN ({GAP_SQL}) g USING (symbol, bar_idx) JOIN ({BLOCK_SQL}) k USING (symbol, bar_idx))""")


@query("dt09_anchor_windows", "symbol:s anchor:s key:s poc:d8 vah:d8 val:d8 hvn_count:l lvn_count:l shape:s", "SELECT * FROM pa_prof")
def _(m):
    return levels_t(m)


@query("ag14_prior_day_type", "symbol:s session_date:s day_type:l", "SELECT * FROM psx")
def _(m):
    return sessions_t(m)


@query("ag13_session_open", "symbol:s session_date:s session_no:l rth_no:l rth_open_ts:t rth_open ib_high ib_low open_drive:l", "SELECT * FROM ps")
def _(m):
    return plain_sessions_t(m)


@query("ag15_value_area_history", "symbol:s session_date:s va_width:d8 va_mid:d9 width_z:d4 width_median:d9 previous_poc:d8 previous_mid:d9", "SELECT * FROM psx")
def _(m):
    return sessions_t(m)


@query("ff19_profile_features", KEY + OUT, "SELECT * FROM pctx")
def _(m):
    return context_fields_t(m)


# ---- DT11 ---------------------------------------------------------------------------------------------------------------------
_W = "PARTITION BY symbol, session_date ORDER BY bar_idx"
_cl = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_dr = "coalesce(open_drive_flag = 1, false)"
_qt = lambda n: f"CASE WHEN volume_zscore_50 IS NULL THEN 0.5 ELSE {_cl(f'1.0 - greatest(volume_zscore_50, 0.0) / {n}')} END"
_real = {1: f"coalesce(displacement_bullish = 1 AND volume_zscore_50 >= 1.25 AND high > low AND {_cl('(close - low) / (high - low)')} >= 0.75, false)", -1: f"coalesce(displacement_bearish = 1 AND volume_zscore_50 >= 1.25 AND high > low AND {_cl('(high - close) / (high - low)')} >= 0.75, false)"}
_fade = lambda x: f"0.42 + 0.14 * {_cl(f'1.0 - greatest({x}, 0.0) / 0.65')} + 0.08 * (CASE WHEN {x} < 0 THEN {_cl(f'-{x} / 0.30')} ELSE 0 END) + 0.08 * ({_qt('1.25')}) + CASE WHEN {_dr} THEN 0 ELSE 0.06 END"
_CALM = "profile_shape = 0 AND open_type = 0"
_brk = lambda x, s: f"({x} < 0 AND {_real[s]} AND greatest(-{x}, 0.0) >= 0.05)"
_brkc = lambda s, x: f"0.58 + 0.18 * {_cl('(volume_zscore_50 - 1.25) / 2.0')} + 0.12 * {_cl(f'(greatest(-{x}, 0.0) - 0.05) / 0.35')} + CASE WHEN {_dr} THEN 0.05 ELSE 0 END"
_S3 = f"CASE WHEN volume_zscore_50 >= 1.25 THEN CASE WHEN coalesce(above_vah = 1, false) THEN CASE WHEN {_real[1]} AND greatest(-dist_vah_atr, 0.0) >= 0.05 THEN {{'side': 1, 'conf': {_cl(_brkc(1, 'dist_vah_atr'))}}} END WHEN coalesce(below_val = 1, false) THEN CASE WHEN {_real[-1]} AND greatest(-dist_val_atr, 0.0) >= 0.05 THEN {{'side': -1, 'conf': {_cl(_brkc(-1, 'dist_val_atr'))}}} END END END"
_S1 = f"CASE WHEN {_CALM} THEN CASE WHEN dist_vah_atr BETWEEN -0.30 AND 0.65 THEN CASE WHEN NOT coalesce({_brk('dist_vah_atr', 1)}, false) THEN {{'side': -1, 'conf': {_cl(_fade('dist_vah_atr'))}}} END WHEN dist_val_atr BETWEEN -0.30 AND 0.65 AND NOT coalesce({_brk('dist_val_atr', -1)}, false) THEN {{'side': 1, 'conf': {_cl(_fade('dist_val_atr'))}}} END END"


def _retest(born, level, edge, s):
    touch, held = (f"{edge} <= {level} + 0.30 * atr_14", f"close >= {level} - 0.05 * atr_14") if s > 0 else (f"{edge} >= {level} - 0.30 * atr_14", f"close <= {level} + 0.05 * atr_14")
    conf = f"0.63 + 0.19 * {_cl(f'1.0 - least(abs(close - ({level})), abs({edge} - ({level}))) / (0.35 * atr_14)')} + 0.12 * {_cl(f'1.0 - (bar_idx - {born} - 1) / 14.0')}"
    return f"WHEN bar_idx - {born} BETWEEN 1 AND 15 AND atr_14 > 0 AND {touch} AND {held} THEN {{'side': {s}, 'conf': {_cl(conf)}}}"


_S2 = f"CASE {_retest('up_', '(close + dist_vah_atr * atr_14)', 'low', 1)} {_retest('dn_', '(close - dist_val_atr * atr_14)', 'high', -1)} END"
_DEP = "(CASE WHEN side_ < 0 THEN dist_vah_atr ELSE dist_val_atr END)"
_S4 = f"CASE WHEN in_va = 1 AND side_ <> 0 AND n_ BETWEEN 1 AND 3 AND NOT {_dr} AND NOT coalesce(volume_zscore_50 > 0.75, false) AND (CASE WHEN side_ < 0 THEN bars_since_sweep_high ELSE bars_since_sweep_low END) <= 3 AND {_DEP} > 0.05 THEN {{'side': side_, 'conf': {_cl(f'''0.66 + 0.10 * {_cl('1.0 - (n_ - 1) / 2.0')} + 0.10 * ({_qt('0.75')}) + 0.10 * {_cl(f'({_DEP} - 0.05) / 0.25')}''')}}} END"
_N5 = _cl(f"0.61 + 0.24 * {_cl('1.0 - dist_nearest_lvn_atr / 0.3')} + CASE WHEN {_dr} THEN 0.05 ELSE 0 END")
_S5 = f"CASE WHEN dist_nearest_lvn_atr <= 0.3 THEN CASE WHEN displacement_bullish = 1 THEN {{'side': 1, 'conf': {_N5}}} WHEN displacement_bearish = 1 THEN {{'side': -1, 'conf': {_N5}}} END END"
_LE, _MO = "least(hvn_above_close, hvn_below_close)", "greatest(hvn_above_close, hvn_below_close)"
_S6 = f"CASE WHEN {_CALM} AND in_va = 1 AND NOT {_dr} AND displacement_bullish = 0 AND displacement_bearish = 0 AND NOT coalesce(volume_zscore_50 > 0.5, false) AND hvn_above_close IS NOT NULL AND hvn_below_close IS NOT NULL AND {_LE} > 0.75 AND {_LE} < 2.5 AND {_MO} - {_LE} >= 0.3 AND {_MO} / greatest({_LE}, 1e-8) >= 1.35 THEN {{'side': CASE WHEN hvn_above_close < hvn_below_close THEN 1 ELSE -1 END, 'conf': {_cl(f'''0.50 + 0.12 * {_cl(f'{_LE} - 0.75')} + 0.12 * {_cl(f'{_MO} - {_LE}')} + 0.08 * ({_qt('0.5')})''')}}} END"
_PICK = ", ".join(f"CASE WHEN s{k} IS NOT NULL AND s{k}.side IS DISTINCT FROM lag(s{k}.side) OVER ({_W}) THEN {{'conf': s{k}.conf, 'p': {-p}, 'k': {-k}, 'side': s{k}.side}} END" for k, p in pf.PRIORITY.items())
SETUPS_SQL = f"""SELECT *, coalesce(-pick.k, 0) AS setup_type, coalesce(pick.side, 0) AS setup_side, coalesce(pick.conf, 0) AS setup_confidence, {', '.join(f's{k}.side AS s{k}_side, s{k}.conf AS s{k}_conf' for k in pf.PRIORITY)}, CASE WHEN pick.k = -4 AND (coalesce(bars_since_sweep_high <= 3, false) OR coalesce(bars_since_sweep_low <= 3, false)) THEN 1 ELSE 0 END AS failed_auction_with_sweep FROM (
 SELECT *, list_max(list_filter([{_PICK}], lambda x: x IS NOT NULL)) AS pick FROM (SELECT *, {_S1} AS s1, {_S2} AS s2, {_S4} AS s4, {_S5} AS s5, {_S6} AS s6 FROM (
 SELECT *, coalesce(lag(run_) OVER ({_W}), 0) AS side_, coalesce(lag(len_) OVER ({_W}), 0) AS n_, last_value(CASE WHEN s3.side = 1 THEN bar_idx END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up_, last_value(CASE WHEN s3.side = -1 THEN bar_idx END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dn_ FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, session_date, isl_ ORDER BY bar_idx) AS len_ FROM (SELECT *, sum(CASE WHEN run_ IS DISTINCT FROM pr_ THEN 1 ELSE 0 END) OVER ({_W}) AS isl_ FROM (SELECT *, lag(run_) OVER ({_W}) AS pr_ FROM (
 SELECT *, {_S3} AS s3, CASE WHEN coalesce(above_vah = 1, false) THEN -1 WHEN coalesce(below_val = 1, false) THEN 1 ELSE 0 END AS run_ FROM pctx)))))))"""


@query("dt11_profile_setups", KEY + "setup_type:l setup_side:l setup_confidence:d5 failed_auction_with_sweep:l " + " ".join(f"s{k}_side:l s{k}_conf:d5" for k in sorted(pf.PRIORITY)), SETUPS_SQL)
def _(m):
    return pf.setups(context_fields_t(m))

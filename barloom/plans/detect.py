"""DT01-DT08 and the structure-pattern families FF17, FF18."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators import features as ff
from barloom.operators import patterns as pt
from barloom.operators.blocks import blocked
from barloom.plans.base import NYSQL
from barloom.plans.registry import (S, query, s_div, s_flag, s_lag, s_last, s_max, s_mean, s_min, s_since, shared)

KEY = "symbol:s bar_idx:l "


def swings_t(m):
    return m.stage("pt_swings", lambda: pt.with_swings(m.bars()))


def pools_t(m):
    return m.stage("pt_pools", lambda: pt.pool_context(swings_t(m)))


def refs_t(m):
    return m.stage("pt_refs", lambda: pt.reference_levels(pools_t(m)))


def sweeps_t(m):
    return m.stage("pt_sweeps", lambda: pt.sweeps(refs_t(m)))


def disp_t(m):
    return m.stage("pt_disp", lambda: pt.displacement(sweeps_t(m)))


def struct_t(m):
    return m.stage("pt_struct", lambda: pt.structure_breaks(disp_t(m)))


def gaps_t(m):
    return m.stage("pt_gaps", lambda: pt.gap_context(struct_t(m)))


def blocks_t(m):
    return m.stage("pt_blocks", lambda: pt.block_context(gaps_t(m)))


def context_t(m):
    def build():
        near = lambda x: flag(c(x) <= 1.0)
        d = pt.premium_discount(blocks_t(m))
        d = d.withColumns({"bull_confluence": near("dist_to_bull_fvg_atr") + near("dist_to_bull_order_block_atr") + near("dist_to_equal_low_pool_atr"),
                           "bear_confluence": near("dist_to_bear_fvg_atr") + near("dist_to_bear_order_block_atr") + near("dist_to_equal_high_pool_atr")})
        return d.withColumns({"total_confluence": c("bull_confluence") + c("bear_confluence"), "zone_balance": c("bull_confluence") - c("bear_confluence")})
    return m.stage("pt_context", build)


_R3 = f"OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
shared("pt_sw", f"""SELECT *, CASE WHEN atr_fill > 0 THEN atr_fill ELSE 1.0 END AS atr_pos, {s_div('latest_swing_high - close', 'atr_14')} AS latest_high_dist_atr,
 {s_div('close - latest_swing_low', 'atr_14')} AS latest_low_dist_atr FROM (
 SELECT *, {s_last('swing_high_level')} AS latest_swing_high, {s_last('swing_low_level')} AS latest_swing_low,
 {s_last('CASE WHEN swing_high_level IS NOT NULL THEN bar_idx - 3 END')} AS latest_high_idx, {s_last('CASE WHEN swing_low_level IS NOT NULL THEN bar_idx - 3 END')} AS latest_low_idx,
 coalesce({s_last('atr_14')}, 0) AS atr_fill, {s_div('swing_high_level - close', 'atr_14')} AS high_tax_atr, {s_div('close - swing_low_level', 'atr_14')} AS low_tax_atr FROM (
 SELECT *, coalesce({s_lag('rh', 3)}, 0) AS confirmed_swing_high, coalesce({s_lag('rl', 3)}, 0) AS confirmed_swing_low, CASE WHEN {s_lag('rh', 3)} = 1 THEN {s_lag('high', 3)} END AS swing_high_level,
 CASE WHEN {s_lag('rl', 3)} = 1 THEN {s_lag('low', 3)} END AS swing_low_level FROM (
 SELECT *, {s_flag(f"high > {s_max('high', 3, 1)} AND count(*) {_R3} = 3 AND high > max(high) {_R3}")} AS rh, {s_flag(f"low < {s_min('low', 3, 1)} AND count(*) {_R3} = 3 AND low < min(low) {_R3}")} AS rl FROM vol)))""")


def pool_sql(side):
    hi = side == 1
    lv = "swing_high_level" if hi else "swing_low_level"
    n = "high" if hi else "low"
    pierce = f"b2.high > z.upper" if hi else "b2.low < z.lower"
    return f"""SELECT b.symbol, b.bar_idx, count(*) AS n, min(row(CASE WHEN b.close < z.lower THEN z.lower - b.close WHEN b.close > z.upper THEN b.close - z.upper ELSE 0.0 END, z.born, z.mid)) AS best FROM (
 SELECT symbol, bar_idx AS born, ({lv} + pl) / 2.0 - tol2 AS lower, ({lv} + pl) / 2.0 + tol2 AS upper, ({lv} + pl) / 2.0 AS mid FROM (
 SELECT *, greatest(tol, ptol) AS tol2 FROM (SELECT *, {s_last(lv, strict=True)} AS pl, {s_last(f'CASE WHEN {lv} IS NOT NULL THEN bar_idx END', strict=True)} AS pi,
 {s_last(f'CASE WHEN {lv} IS NOT NULL THEN tol END', strict=True)} AS ptol FROM (SELECT *, atr_pos * 0.2 AS tol FROM pt_sw)))
 WHERE {lv} IS NOT NULL AND pl IS NOT NULL AND bar_idx - pi >= 3 AND abs({lv} - pl) <= tol2) z
 JOIN bars b ON b.symbol = z.symbol AND b.bar_idx BETWEEN z.born AND z.born + 120
 WHERE NOT EXISTS (SELECT 1 FROM bars b2 WHERE b2.symbol = z.symbol AND b2.bar_idx > z.born AND b2.bar_idx <= b.bar_idx AND {pierce}) GROUP BY 1, 2"""


shared("pt_pool", f"""SELECT s.*, coalesce(h.n, 0) AS active_equal_high_pool_count, coalesce(l.n, 0) AS active_equal_low_pool_count, h.best[1] / atr_pos AS dist_to_equal_high_pool_atr,
 l.best[1] / atr_pos AS dist_to_equal_low_pool_atr, s.bar_idx - h.best[2] AS equal_high_pool_age_bars, s.bar_idx - l.best[2] AS equal_low_pool_age_bars,
 h.best[3] AS equal_high_pool_level, l.best[3] AS equal_low_pool_level FROM pt_sw s LEFT JOIN ({pool_sql(1)}) h ON h.symbol = s.symbol AND h.bar_idx = s.bar_idx
 LEFT JOIN ({pool_sql(-1)}) l ON l.symbol = s.symbol AND l.bar_idx = s.bar_idx""")


@query("dt01_swings_pools", KEY + """confirmed_swing_high:l confirmed_swing_low:l latest_swing_high latest_swing_low latest_high_idx:l latest_low_idx:l high_tax_atr low_tax_atr
 latest_high_dist_atr latest_low_dist_atr active_equal_high_pool_count:l active_equal_low_pool_count:l dist_to_equal_high_pool_atr dist_to_equal_low_pool_atr
 equal_high_pool_age_bars:l equal_low_pool_age_bars:l equal_high_pool_level equal_low_pool_level""", "SELECT * FROM pt_pool")
def _(m):
    return pools_t(m)


def ref_sql(src, s="PARTITION BY symbol, session_date ORDER BY bar_idx"):
    day = "PARTITION BY symbol, local_date ORDER BY bar_idx"
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    typ = "(high + low + close) / 3.0"
    return f"""SELECT d.*, CASE WHEN is_overnight THEN _ohd ELSE p._oh END AS overnight_high, CASE WHEN is_overnight THEN _old ELSE p._ol END AS overnight_low,
 CASE WHEN ib_complete THEN p._ih END AS ib_high, CASE WHEN ib_complete THEN p._il END AS ib_low, p.prior_rth_high, p.prior_rth_low, p.prior_rth_close, w.prior_week_high, w.prior_week_low,
 last_value(_rv IGNORE NULLS) OVER ({s.replace('symbol,', 'd.symbol,').replace('session_date', 'd.session_date')} {run}) AS rth_vwap, rth_open - p.prior_rth_close AS rth_gap_open FROM (
 SELECT *, CASE WHEN is_rth AND mloc >= 870 THEN 5 WHEN is_rth AND mloc >= 720 AND mloc < 810 THEN 4 WHEN is_ib THEN 2 WHEN is_rth THEN 3 WHEN is_overnight THEN 1 ELSE 0 END AS phase_code,
 max(CASE WHEN is_overnight THEN high END) OVER ({s} {run}) AS _ohd, min(CASE WHEN is_overnight THEN low END) OVER ({s} {run}) AS _old,
 CASE WHEN is_ib THEN max(CASE WHEN is_ib THEN high END) OVER ({s} {run}) END AS ib_high_developing, CASE WHEN is_ib THEN min(CASE WHEN is_ib THEN low END) OVER ({s} {run}) END AS ib_low_developing,
 last_value(CASE WHEN is_rth AND mloc = 570 THEN open END IGNORE NULLS) OVER ({s} {run}) AS rth_open, sum({typ} * volume) OVER ({s} {run}) / sum(volume) OVER ({s} {run}) AS session_vwap,
 CASE WHEN is_rth THEN sum(CASE WHEN is_rth THEN {typ} * volume ELSE 0 END) OVER ({s} {run}) / sum(CASE WHEN is_rth THEN volume ELSE 0 END) OVER ({s} {run}) END AS _rv,
 last_value(CASE WHEN mloc = 0 THEN open END IGNORE NULLS) OVER ({day} {run}) AS midnight_open, last_value(CASE WHEN mloc = 510 THEN open END IGNORE NULLS) OVER ({day} {run}) AS open_0830,
 {s_flag('is_rth AND mloc < 600')} AS open_drive_flag, {s_flag('mloc >= 720 AND mloc < 810')} AS lunch_lull_flag, {s_flag('is_rth AND mloc >= 900')} AS close_ramp_flag
 FROM ({session_eq_sql(src)})) d
 JOIN (SELECT symbol, session_date, _oh, _ol, _ih, _il, last_value(_rh IGNORE NULLS) OVER x AS prior_rth_high, last_value(_rl IGNORE NULLS) OVER x AS prior_rth_low,
 last_value(_rc IGNORE NULLS) OVER x AS prior_rth_close FROM ({ref_sess(src)}) WINDOW x AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) p
 ON p.symbol = d.symbol AND p.session_date = d.session_date
 JOIN (SELECT symbol, week_key, last_value(wh IGNORE NULLS) OVER x AS prior_week_high, last_value(wl IGNORE NULLS) OVER x AS prior_week_low FROM (
 SELECT symbol, week_key, max(_rh) AS wh, min(_rl) AS wl FROM ({ref_sess(src)}) GROUP BY 1, 2) WINDOW x AS (PARTITION BY symbol ORDER BY week_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) w
 ON w.symbol = d.symbol AND w.week_key = d.week_key"""


def session_eq_sql(src):
    return f"""SELECT *, session_date + CAST((5 - isodow(session_date) + 7) % 7 AS INTEGER) AS week_key, mloc >= 960 OR mloc < 570 AS is_overnight, hol = 0 AND mloc >= 570 AND mloc < 960 AS is_rth,
 hol = 0 AND mloc >= 570 AND mloc < 630 AS is_ib, hol = 0 AND mloc >= 630 AND mloc < 960 AS ib_complete FROM (
 SELECT *, {s_flag("session_date IN (DATE '2024-01-01', DATE '2024-01-15')")} AS hol FROM (
 SELECT *, CAST({NYSQL} + INTERVAL 8 HOUR AS DATE) AS session_date, CAST({NYSQL} AS DATE) AS local_date, hour({NYSQL}) * 60 + minute({NYSQL}) AS mloc FROM {src}))"""


def ref_sess(src):
    return f"""SELECT symbol, session_date, week_key, max(CASE WHEN is_rth THEN high END) AS _rh, min(CASE WHEN is_rth THEN low END) AS _rl, arg_max(close, bar_idx) FILTER (is_rth) AS _rc,
 max(CASE WHEN is_overnight THEN high END) AS _oh, min(CASE WHEN is_overnight THEN low END) AS _ol, max(CASE WHEN is_ib THEN high END) AS _ih, min(CASE WHEN is_ib THEN low END) AS _il
 FROM ({session_eq_sql(src)}) GROUP BY 1, 2, 3"""


REF_OUT = (" ".join(x + (":d8" if x.endswith("vwap") else "") for x in pt.REFERENCE) + " rth_gap_open ib_high_developing ib_low_developing phase_code:l is_rth:l is_overnight:l is_ib:l ib_complete:l open_drive_flag:l lunch_lull_flag:l close_ramp_flag:l")


@query("dt02_reference_levels", KEY + REF_OUT, f"SELECT * FROM ({ref_sql('fine')})")
def _(m):
    return pt.reference_levels(m.bars(900))


shared("pt_ref", ref_sql("pt_pool"))


def sweep_sql():
    parts, fails = [], []
    for k, (lv, s, code) in enumerate(pt.SWEEP_LEVELS):
        hit = f"high >= {lv} + buf" if s == 1 else f"low <= {lv} - buf"
        back = lambda cl, l: f"{cl} < {l}" if s == 1 else f"{cl} > {l}"
        pen = f"greatest(({'high - ' + lv if s == 1 else lv + ' - low'}) / greatest(atr_fill, 1e-6), 0)"
        parts.append(f"SELECT symbol, bar_idx, {k} AS k, 0 AS nd, {code} AS code, {s} AS dir, {pen} AS pen, {lv} AS lv FROM x WHERE {hit} AND {back('close', lv)}")
        parts.append(f"SELECT symbol, bar_idx + 1, {k}, -1, {code}, {s}, {pen}, {lv} FROM x WHERE {hit} AND NOT ({back('close', lv)}) AND {back('nclose', lv)}")
        fails.append(f"SELECT symbol, bar_idx + 1 AS bar_idx, {s} AS dir FROM x WHERE {hit} AND NOT ({back('close', lv)}) AND NOT ({back('nclose', lv)})")
    return f"""WITH x AS (SELECT *, greatest(coalesce(atr_14, 0) * 0.05, 0.25) AS buf, lead(close) OVER ({S}) AS nclose FROM pt_ref), e AS ({' UNION ALL '.join(parts)}), f AS ({' UNION ALL '.join(fails)})
 SELECT r.*, coalesce(g.buy, 0) AS buy_side_sweep, coalesce(g.sell, 0) AS sell_side_sweep, CASE WHEN g.symbol IS NULL THEN 0 ELSE 1 END AS sweep_any, coalesce(fb.b, 0) AS failed_buy_side_sweep,
 coalesce(fb.s, 0) AS failed_sell_side_sweep, coalesce(g.code, 0) AS sweep_level_code, g.pen AS sweep_penetration_atr, g.delay AS sweep_reclaim_bars, g.lv AS sweep_level_value, coalesce(g.dir, 0) AS sweep_direction
 FROM pt_ref r LEFT JOIN (SELECT symbol, bar_idx, max(CASE WHEN dir = 1 THEN 1 ELSE 0 END) AS buy, max(CASE WHEN dir = -1 THEN 1 ELSE 0 END) AS sell, arg_max(code, (k, nd)) AS code, arg_max(pen, (k, nd)) AS pen,
 arg_max(-nd, (k, nd)) AS delay, arg_max(lv, (k, nd)) AS lv, arg_max(dir, (k, nd)) AS dir FROM e GROUP BY 1, 2) g ON g.symbol = r.symbol AND g.bar_idx = r.bar_idx
 LEFT JOIN (SELECT symbol, bar_idx, max(CASE WHEN dir = 1 THEN 1 ELSE 0 END) AS b, max(CASE WHEN dir = -1 THEN 1 ELSE 0 END) AS s FROM f GROUP BY 1, 2) fb ON fb.symbol = r.symbol AND fb.bar_idx = r.bar_idx"""


shared("pt_swp", f"""SELECT *, {s_since('buy_side_sweep = 1')} AS since_buy_sweep, {s_since('sell_side_sweep = 1')} AS since_sell_sweep, {s_since('sweep_any = 1')} AS since_sweep_any FROM ({sweep_sql()})""")


@query("dt03_sweeps", KEY + """buy_side_sweep:l sell_side_sweep:l sweep_any:l failed_buy_side_sweep:l failed_sell_side_sweep:l sweep_level_code:l sweep_penetration_atr sweep_reclaim_bars:l
 sweep_level_value sweep_direction:l since_buy_sweep:l since_sell_sweep:l since_sweep_any:l""", "SELECT * FROM pt_swp")
def _(m):
    return sweeps_t(m)


_G50 = "OVER (PARTITION BY symbol, phase_code ORDER BY bar_idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_G20 = "OVER (PARTITION BY symbol, phase_code ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_BIG = "disp_range_atr >= 1.5 AND disp_body_to_range >= 0.65 AND coalesce(volume_phase_z >= 0.5, false)"
shared("pt_dsp", f"""SELECT *, {s_last('CASE WHEN disp_bull = 1 THEN bar_idx END')} AS latest_bull_disp_idx, {s_last('CASE WHEN disp_bear = 1 THEN bar_idx END')} AS latest_bear_disp_idx,
 {s_last('CASE WHEN disp_bull = 1 THEN low END')} AS latest_bull_disp_origin, {s_last('CASE WHEN disp_bear = 1 THEN high END')} AS latest_bear_disp_origin,
 {s_since('disp_bull = 1')} AS since_disp_bull, {s_since('disp_bear = 1')} AS since_disp_bear FROM (
 SELECT *, {s_flag(f'close > open AND {_BIG} AND disp_close_location >= 0.75')} AS disp_bull, {s_flag(f'close < open AND {_BIG} AND disp_close_location <= 0.25')} AS disp_bear,
 disp_range_atr * 0.45 + disp_body_to_range * 0.25 + greatest(coalesce(volume_phase_z, 0), 0) / 3.0 * 0.20 + abs(disp_close_location - 0.5) * 2.0 * 0.10 AS disp_score FROM (
 SELECT *, CASE WHEN count(volume) {_G50} >= 20 AND min(volume) {_G50} <> max(volume) {_G50} THEN (volume - avg(volume) {_G50}) / stddev_samp(volume) {_G50} END AS volume_phase_z,
 CASE WHEN count(volume) {_G20} >= 5 THEN volume / avg(volume) {_G20} END AS volume_phase_rel, {s_div('abs(close - open)', 'high - low', 0.0)} AS disp_body_to_range,
 {s_div('high - low', 'atr_14', 0.0)} AS disp_range_atr, {s_div('close - low', 'high - low', 0.5)} AS disp_close_location FROM pt_swp))""")


@query("dt04_displacement", KEY + """volume_phase_z volume_phase_rel disp_body_to_range disp_range_atr disp_close_location disp_score disp_bull:l disp_bear:l latest_bull_disp_idx:l latest_bear_disp_idx:l
 latest_bull_disp_origin latest_bear_disp_origin since_disp_bull:l since_disp_bear:l""", "SELECT * FROM pt_dsp")
def _(m):
    return disp_t(m)


@query("wn20_grouped_rolling_zscore", KEY + "phase_code:l volume_phase_z", "SELECT * FROM pt_dsp")
def _(m):
    return disp_t(m)


_BULL = "s.high > s.latest_swing_high + s.buf AND (r.hi_seen IS NULL OR abs(s.latest_swing_high - r.hi_seen) > s.buf / 2)"
_BEAR = "s.low < s.latest_swing_low - s.buf AND (r.lo_seen IS NULL OR abs(s.latest_swing_low - r.lo_seen) > s.buf / 2)"
STRUCT_SQL = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, greatest(coalesce(atr_14, 0) * 0.05, 0.25) AS buf, coalesce(since_sell_sweep <= 3, false) AS rs, coalesce(since_buy_sweep <= 3, false) AS rb FROM pt_dsp),
 r AS (SELECT symbol, bar_idx, 0 AS break_kind, 0 AS structure_state, CAST(NULL AS DOUBLE) AS structure_break_level, CAST(NULL AS DOUBLE) AS hi_seen, CAST(NULL AS DOUBLE) AS lo_seen FROM s WHERE bar_idx = 0
 UNION ALL SELECT s.symbol, s.bar_idx, CASE WHEN {_BULL} THEN CASE WHEN r.structure_state = -1 THEN CASE WHEN s.rs THEN 3 ELSE 2 END ELSE 1 END
 WHEN {_BEAR} THEN CASE WHEN r.structure_state = 1 THEN CASE WHEN s.rb THEN -3 ELSE -2 END ELSE -1 END ELSE 0 END, CASE WHEN {_BULL} THEN 1 WHEN {_BEAR} THEN -1 ELSE r.structure_state END,
 CASE WHEN {_BULL} THEN s.latest_swing_high WHEN {_BEAR} THEN s.latest_swing_low END, CASE WHEN {_BULL} THEN s.latest_swing_high ELSE r.hi_seen END,
 CASE WHEN ({_BULL}) IS NOT TRUE AND ({_BEAR}) THEN s.latest_swing_low ELSE r.lo_seen END FROM r JOIN s ON s.symbol = r.symbol AND s.bar_idx = r.bar_idx + 1)
 SELECT d.*, r.break_kind, r.structure_state, r.structure_break_level, {s_flag('break_kind = 1')} AS bos_bull, {s_flag('break_kind = -1')} AS bos_bear, {s_flag('break_kind >= 2')} AS choch_bull,
 {s_flag('break_kind <= -2')} AS choch_bear FROM pt_dsp d JOIN r ON r.symbol = d.symbol AND r.bar_idx = d.bar_idx"""


@query("dt05_market_structure", KEY + "break_kind:l structure_state:l structure_break_level bos_bull:l bos_bear:l choch_bull:l choch_bear:l", STRUCT_SQL)
def _(m):
    return struct_t(m)


_ZD = "CASE WHEN b.close < z.lower THEN z.lower - b.close WHEN b.close > z.upper THEN b.close - z.upper ELSE 0.0 END"
_PZ = "PARTITION BY symbol, zone_id ORDER BY step"
GAP_SQL = f"""WITH g AS (SELECT *, {s_lag('high', 2)} AS h2, {s_lag('low', 2)} AS l2, greatest(coalesce(atr_14, 0) * 0.15, 0.25) AS need FROM pt_dsp),
 z AS (SELECT symbol, bar_idx AS born, bar_idx * 2 AS zone_id, 1 AS side, h2 AS lower, low AS upper, disp_bull AS by_disp FROM g WHERE low - h2 > need UNION ALL SELECT symbol, bar_idx, bar_idx * 2 + 1, -1, high, l2, disp_bear FROM g WHERE l2 - high > need),
 p AS (SELECT z.*, b.bar_idx, b.bar_idx - z.born AS step, b.close, {_ZD} AS dist, CASE WHEN b.bar_idx > z.born AND b.close < z.lower THEN -1 WHEN b.bar_idx > z.born AND b.close > z.upper THEN 1 END AS sig,
 CASE WHEN b.bar_idx > z.born THEN greatest(least(b.high, z.upper) - greatest(b.low, z.lower), 0) ELSE 0 END AS ov, CASE WHEN b.low <= (z.lower + z.upper) / 2 AND b.high >= (z.lower + z.upper) / 2 THEN 1 ELSE 0 END AS mid
 FROM z JOIN bars b ON b.symbol = z.symbol AND b.bar_idx BETWEEN z.born AND z.born + 120),
 q1 AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER ({_PZ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), side) AS bef, coalesce(last_value(sig IGNORE NULLS) OVER ({_PZ} ROWS UNBOUNDED PRECEDING), side) AS dir,
 max(ov / greatest(upper - lower, 0.25)) OVER ({_PZ} ROWS UNBOUNDED PRECEDING) AS mit, max(CASE WHEN ov > 0 THEN mid ELSE 0 END) OVER ({_PZ} ROWS UNBOUNDED PRECEDING) AS tap FROM p),
 q2 AS (SELECT *, max(CASE WHEN sig <> bef THEN 1 ELSE 0 END) OVER ({_PZ} ROWS UNBOUNDED PRECEDING) AS inv, last_value(CASE WHEN sig <> bef THEN bar_idx END IGNORE NULLS) OVER ({_PZ} ROWS UNBOUNDED PRECEDING) AS inv_at FROM q1),
 a AS (SELECT symbol, bar_idx, {', '.join(f"count(*) FILTER (dir = {s}) AS n_{n}, sum(inv) FILTER (dir = {s}) AS i_{n}, min(row(dist, born, zone_id, lower, upper, mit, tap, inv, inv_at, by_disp)) FILTER (dir = {s}) AS z_{n}" for s, n in ((1, 'bull'), (-1, 'bear')))} FROM q2 GROUP BY 1, 2)
 SELECT d.symbol, d.bar_idx, {', '.join(f"coalesce(n_{n}, 0) AS active_{n}_fvg_count, coalesce(i_{n}, 0) AS active_{n}_ifvg_count, z_{n}[1] / atr_pos AS dist_to_{n}_fvg_atr, coalesce(z_{n}[8], 0) AS nearest_{n}_is_ifvg, coalesce(z_{n}[7], 0) AS {n}_fvg_ce_tapped, z_{n}[6] AS {n}_fvg_mitigation, z_{n}[4] AS nearest_{n}_fvg_lower, z_{n}[5] AS nearest_{n}_fvg_upper, z_{n}[2] AS nearest_{n}_fvg_formed, z_{n}[3] AS nearest_{n}_fvg_id, (z_{n}[4] + z_{n}[5]) / 2.0 AS nearest_{n}_fvg_ce, z_{n}[9] AS nearest_{n}_fvg_inversion, coalesce(z_{n}[10], 0) AS nearest_{n}_fvg_by_disp" for n in ('bull', 'bear'))}
 FROM pt_dsp d LEFT JOIN a ON a.symbol = d.symbol AND a.bar_idx = d.bar_idx"""


@query("dt06_fair_value_gaps", KEY + " ".join(f"active_{n}_fvg_count:l active_{n}_ifvg_count:l dist_to_{n}_fvg_atr nearest_{n}_is_ifvg:l {n}_fvg_ce_tapped:l {n}_fvg_mitigation nearest_{n}_fvg_lower nearest_{n}_fvg_upper nearest_{n}_fvg_formed:l"
                                              for n in ("bull", "bear")), GAP_SQL)
def _(m):
    return gaps_t(m)


BLK_OUT = " ".join(f"active_{s}_{n}_count:l dist_to_{s}_{n}_atr {s}_{n}_age_bars:l {s}_{n}_retests:l {s}_{n}_retest_event:l" for n in ("order_block", "breaker") for s in ("bull", "bear"))


def life_sql(z, extra=""):
    return f"""SELECT *, sum(CASE WHEN touch AND dead = 0 THEN 1 ELSE 0 END) OVER ({_PZ} ROWS UNBOUNDED PRECEDING) AS retests FROM (SELECT *, sum(broke) OVER ({_PZ} ROWS UNBOUNDED PRECEDING) AS dead FROM (
 SELECT z.*, b.bar_idx, b.bar_idx - z.born AS step, b.close, {_ZD} AS dist, b.bar_idx > z.born AND b.high >= z.lower AND b.low <= z.upper AS touch{extra},
 CASE WHEN b.bar_idx > z.born AND ((z.side = 1 AND b.close < z.lower - 0.25) OR (z.side = -1 AND b.close > z.upper + 0.25)) THEN 1 ELSE 0 END AS broke FROM {z} z JOIN t b ON b.symbol = z.symbol AND b.bar_idx BETWEEN z.born AND z.born + 120))"""


def life_agg(rows, nm):
    return f"SELECT symbol, bar_idx, {', '.join(f'count(*) FILTER (side = {s}) AS n_{n}, min(row(dist, born, zone_id, retests, CASE WHEN touch THEN 1 ELSE 0 END, lower, upper, source_born)) FILTER (side = {s}) AS z_{n}' for s, n in ((1, 'bull'), (-1, 'bear')))} FROM {rows} WHERE dead = 0 GROUP BY 1, 2"


BLOCK_SQL = f"""WITH t AS MATERIALIZED (SELECT *, {s_lag('open')} AS o1, {s_lag('close')} AS c1 FROM ({STRUCT_SQL})),
 ob AS (SELECT symbol, bar_idx AS born, bar_idx * 2 AS zone_id, 1 AS side, least(o1, c1) AS lower, greatest(o1, c1) AS upper, CAST(NULL AS BIGINT) AS source_born FROM t WHERE disp_bull = 1 AND (bos_bull = 1 OR choch_bull = 1) AND c1 < o1
 UNION ALL SELECT symbol, bar_idx, bar_idx * 2 + 1, -1, least(o1, c1), greatest(o1, c1), NULL FROM t WHERE disp_bear = 1 AND (bos_bear = 1 OR choch_bear = 1) AND c1 > o1),
 l1 AS MATERIALIZED ({life_sql('ob', ', b.disp_bear = 1 AND b.choch_bear = 1 AND b.since_buy_sweep <= 5 AS sdn, b.disp_bull = 1 AND b.choch_bull = 1 AND b.since_sell_sweep <= 5 AS sup')}),
 br AS (SELECT symbol, bar_idx AS born, zone_id + bar_idx * 1000003 AS zone_id, -side AS side, lower, upper, born AS source_born FROM l1 WHERE broke = 1 AND dead = 1 AND ((side = 1 AND sdn) OR (side = -1 AND sup))),
 l2 AS ({life_sql('br')}), a1 AS ({life_agg('l1', 'order_block')}), a2 AS ({life_agg('l2', 'breaker')})
 SELECT t.symbol, t.bar_idx, {', '.join(f"coalesce({a}.n_{s}, 0) AS active_{s}_{n}_count, {a}.z_{s}[1] / atr_pos AS dist_to_{s}_{n}_atr, t.bar_idx - {a}.z_{s}[2] AS {s}_{n}_age_bars, {a}.z_{s}[4] AS {s}_{n}_retests, coalesce({a}.z_{s}[5], 0) AS {s}_{n}_retest_event, {a}.z_{s}[6] AS nearest_{s}_{n}_lower, {a}.z_{s}[7] AS nearest_{s}_{n}_upper, {a}.z_{s}[3] AS nearest_{s}_{n}_id, {a}.z_{s}[2] AS nearest_{s}_{n}_formed, {a}.z_{s}[8] AS nearest_{s}_{n}_source_formed" for a, n in (('a1', 'order_block'), ('a2', 'breaker')) for s in ('bull', 'bear'))}
 FROM t LEFT JOIN a1 ON a1.symbol = t.symbol AND a1.bar_idx = t.bar_idx LEFT JOIN a2 ON a2.symbol = t.symbol AND a2.bar_idx = t.bar_idx"""


@query("dt07_order_blocks_breakers", KEY + BLK_OUT, BLOCK_SQL)
def _(m):
    return blocks_t(m)


_UP = "[prior_rth_high, overnight_high, ib_high, prior_week_high, equal_high_pool_level, latest_swing_high]"
_DN = "[prior_rth_low, overnight_low, ib_low, prior_week_low, equal_low_pool_level, latest_swing_low]"
PD_SQL = f"""SELECT *, {s_flag('range_pct < 0.5')} AS discount_zone, {s_flag('range_pct > 0.5')} AS premium_zone, {s_flag('retracement BETWEEN 0.62 AND 0.79')} AS in_entry_band,
 abs(retracement - 0.705) AS dist_to_band_mid, CASE WHEN retracement < 0.62 THEN -1 WHEN retracement > 0.79 THEN 1 ELSE 0 END AS band_bucket,
 {s_div('dol_up - close', 'atr_14')} AS dol_up_atr, {s_div('close - dol_down', 'atr_14')} AS dol_down_atr FROM (
 SELECT *, CASE impulse_direction WHEN 1 THEN {s_div('latest_swing_high - close', 'range_high - range_low')} WHEN -1 THEN {s_div('close - latest_swing_low', 'range_high - range_low')} END AS retracement,
 list_min(list_filter({_UP}, lambda x: x > close)) AS dol_up, list_max(list_filter({_DN}, lambda x: x < close)) AS dol_down FROM (
 SELECT *, CASE WHEN latest_swing_high IS NOT NULL AND latest_swing_low IS NOT NULL THEN {s_div('close - range_low', 'range_high - range_low')} END AS range_pct FROM (
 SELECT *, least(latest_swing_high, latest_swing_low) AS range_low, greatest(latest_swing_high, latest_swing_low) AS range_high,
 CASE WHEN latest_high_idx > latest_low_idx THEN 1 WHEN latest_low_idx > latest_high_idx THEN -1 ELSE 0 END AS impulse_direction FROM pt_ref)))"""


@query("dt08_premium_discount", KEY + "range_low range_high range_pct impulse_direction:l retracement discount_zone:l premium_zone:l in_entry_band:l dist_to_band_mid band_bucket:l dol_up dol_down dol_up_atr dol_down_atr", PD_SQL)
def _(m):
    return pt.premium_discount(refs_t(m))


@query("ff17_structure_context", KEY + "bull_confluence:l bear_confluence:l total_confluence:l zone_balance:l",
       f"""SELECT *, bull_confluence + bear_confluence AS total_confluence, bull_confluence - bear_confluence AS zone_balance FROM (SELECT p.symbol, p.bar_idx,
 {s_flag('g.dist_to_bull_fvg_atr <= 1')} + {s_flag('b.dist_to_bull_order_block_atr <= 1')} + {s_flag('p.dist_to_equal_low_pool_atr <= 1')} AS bull_confluence,
 {s_flag('g.dist_to_bear_fvg_atr <= 1')} + {s_flag('b.dist_to_bear_order_block_atr <= 1')} + {s_flag('p.dist_to_equal_high_pool_atr <= 1')} AS bear_confluence
 FROM pt_pool p JOIN ({GAP_SQL}) g ON g.symbol = p.symbol AND g.bar_idx = p.bar_idx JOIN ({BLOCK_SQL}) b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx)""")
def _(m):
    return context_t(m)


INTER = ["bull_sweep_plus_fvg", "bear_sweep_plus_fvg", "bull_sweep_plus_ob", "bear_sweep_plus_ob", "bull_choch_after_sweep", "bear_choch_after_sweep", "sweep_plus_choch",
         "displacement_after_sweep", "fvg_retrace_after_displacement", "bull_zone_in_discount", "bear_zone_in_premium"]
_RC = "t.since_sweep_any <= 3"
_NB, _NS, _OB, _OS = "g.dist_to_bull_fvg_atr <= 1", "g.dist_to_bear_fvg_atr <= 1", "b.dist_to_bull_order_block_atr <= 1", "b.dist_to_bear_order_block_atr <= 1"
_INTER = [f"{_RC} AND {_NB}", f"{_RC} AND {_NS}", f"{_RC} AND {_OB}", f"{_RC} AND {_OS}", f"{_RC} AND t.choch_bull = 1", f"{_RC} AND t.choch_bear = 1",
          f"{_RC} AND (t.choch_bull = 1 OR t.choch_bear = 1)", f"{_RC} AND (t.disp_bull = 1 OR t.disp_bear = 1)", f"(t.disp_bull = 1 AND {_NB}) OR (t.disp_bear = 1 AND {_NS})",
          f"s.price_position_50 <= 0.5 AND ({_NB} OR {_OB})", f"s.price_position_50 >= 0.5 AND ({_NS} OR {_OS})"]


@query("ff18_structure_interactions", KEY + " ".join(f"{x}:l" for x in INTER),
       f"""SELECT t.symbol, t.bar_idx, {', '.join(f'{s_flag(k)} AS {n}' for n, k in zip(INTER, _INTER))} FROM ({STRUCT_SQL}) t JOIN ({GAP_SQL}) g ON g.symbol = t.symbol AND g.bar_idx = t.bar_idx
 JOIN ({BLOCK_SQL}) b ON b.symbol = t.symbol AND b.bar_idx = t.bar_idx JOIN struc s ON s.symbol = t.symbol AND s.bar_idx = t.bar_idx""")
def _(m):
    st = blocked(m.bars(), lambda d, w: ff.structure(ff.volatility(d, w), w), before=61).select("symbol", "bar_idx", "price_position_50")
    return pt.interactions(context_t(m).join(st, ["symbol", "bar_idx"]))

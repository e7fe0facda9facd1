"""DT12: structure setups; the twin states the nine rules as SQL and admits by a recursive query over the bars that hold candidates."""

from __future__ import annotations

from barloom.functions.cols import c
from barloom.operators import setups as su
from barloom.plans.detect import BLOCK_SQL, GAP_SQL, PD_SQL, STRUCT_SQL, context_t
from barloom.plans import policy  # noqa: F401 - registers ff11
from barloom.plans.registry import QUERIES, query, s_lag, s_last

KEY = "symbol:s bar_idx:l "
FIELDS = "confidence anchor_level stop_reference target_reference reference_level reference_level_type:s sweep_type:s htf_context:s zone_id:l"


def setups_t(m):
    def build():
        htf = QUERIES["ff11_htf_context"].build(m).select("symbol", "bar_idx", "htf_ema_alignment")
        return su.candidates(su.setup_inputs(context_t(m).join(htf, ["symbol", "bar_idx"])))
    return m.stage("setups", build)


_NAME = "CASE sweep_level_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in su.LEVEL_NAMES.items()) + " ELSE '' END"
SETUP_IN = f"""SELECT *, coalesce(x_lbt, '') AS last_buy_type, coalesce(x_lst, '') AS last_sell_type FROM (SELECT t.*, p.discount_zone, p.premium_zone, p.in_entry_band, p.impulse_direction, p.dol_up, p.dol_down, g.* EXCLUDE (symbol, bar_idx), b.* EXCLUDE (symbol, bar_idx), h.htf_ema_alignment,
 {s_lag('t.close', 1, 'PARTITION BY t.symbol ORDER BY t.bar_idx')} AS prev_close, {_NAME} AS level_name, {', '.join(f"{s_last(f'CASE WHEN {s}_side_sweep = 1 THEN {v} END', 'PARTITION BY t.symbol ORDER BY t.bar_idx')} AS {n}" for s, v, n in (('buy', 'sweep_level_value', 'last_buy_level'), ('sell', 'sweep_level_value', 'last_sell_level'), ('buy', _NAME, 'x_lbt'), ('sell', _NAME, 'x_lst')))},
 {', '.join(f"t.bar_idx - {s_last(f'CASE WHEN {k} THEN t.bar_idx END', 'PARTITION BY t.symbol ORDER BY t.bar_idx')} AS {n}" for k, n in (('break_kind >= 2', 'since_choch_bull'), ('break_kind <= -2', 'since_choch_bear'), ('break_kind = 3', 'since_mss_bull'), ('break_kind = -3', 'since_mss_bear')))}
 FROM ({STRUCT_SQL}) t JOIN ({PD_SQL}) p USING (symbol, bar_idx) JOIN ({GAP_SQL}) g USING (symbol, bar_idx) JOIN ({BLOCK_SQL}) b USING (symbol, bar_idx) JOIN ({QUERIES['ff11_htf_context'].sql}) h USING (symbol, bar_idx))"""


def _side(s):
    """Short names of one direction, as SQL."""
    long = s > 0
    nm, opp, cn = ("bull", "sell", "bear") if long else ("bear", "buy", "bull")
    pick = f"(dist_to_{nm}_fvg_atr IS NOT NULL AND (dist_to_{nm}_order_block_atr IS NULL OR dist_to_{nm}_fvg_atr <= dist_to_{nm}_order_block_atr))"
    of = lambda a, b: f"(CASE WHEN {pick} THEN nearest_{nm}_fvg_{a} ELSE {b} END)"
    ob = lambda k: f"nearest_{nm}_order_block_{k}"
    br = lambda k: f"nearest_{nm}_breaker_{k}"
    cmp, draw, swing = (">", "dol_up", "latest_swing_high") if long else ("<", "dol_down", "latest_swing_low")
    q = {"nm": nm, "s": s, "cmp": cmp, "ifvg": f"({pick} AND nearest_{nm}_is_ifvg = 1)", "any": f"({pick} OR dist_to_{nm}_order_block_atr IS NOT NULL)"}
    q["zone"] = f"({q['any']} AND NOT {q['ifvg']})"
    q |= {"lower": of("lower", ob("lower")), "upper": of("upper", ob("upper")), "ce": of("ce", f"({ob('lower')} + {ob('upper')}) / 2.0"), "id": of("id", ob("id")),
          "dist": f"(CASE WHEN {pick} THEN dist_to_{nm}_fvg_atr ELSE dist_to_{nm}_order_block_atr END)", "fvg": f"({pick} AND nearest_{nm}_is_ifvg = 0)", "bydisp": f"({pick} AND nearest_{nm}_fvg_by_disp = 1)"}
    q |= {"disp": lambda n: f"coalesce(since_disp_{nm} <= {n}, false)", "swept": lambda n: f"coalesce(since_{opp}_sweep <= {n}, false)", "same": f"coalesce(since_{'buy' if long else 'sell'}_sweep <= 8, false)",
          "mss": lambda n: f"coalesce(since_mss_{nm} <= {n}, false)", "flip": lambda n: f"(coalesce(since_choch_{nm} <= {n}, false) OR coalesce(since_mss_{nm} <= {n}, false))",
          "cflip": f"(coalesce(since_choch_{cn} <= 3, false) OR coalesce(since_mss_{cn} <= 3, false))"}
    q |= {"pd": f"coalesce(in_entry_band = 1 OR {'discount' if long else 'premium'}_zone = 1, false)", "ref": f"last_{opp}_level", "rtype": f"last_{opp}_type", "sweep": f"'{opp}_side'", "origin": f"latest_{nm}_disp_origin", "didx": f"latest_{nm}_disp_idx"}
    q["target"] = f"coalesce(CASE WHEN {draw} {cmp} close THEN {draw} END, CASE WHEN {swing} {cmp} close THEN {swing} END, close + {s} * 2.0 * atr_14)"
    q["stop"] = lambda x: f"({x} - {s} * greatest(0.25, coalesce(atr_14 * 0.25, 0)))"
    q["zstop"] = q["stop"](q["lower"] if long else q["upper"])
    q["trend"] = f"coalesce(CASE WHEN coalesce(htf_ema_alignment, 0) <> 0 THEN htf_ema_alignment * {s} > 0 ELSE structure_state = {s} AND impulse_direction = {s} END, false)"
    q["rev"] = f"(structure_state = {s} OR {q['flip'](8)})"
    q["touch"] = f"coalesce(low <= {q['ce']} AND {q['ce']} <= high, false)"
    q["ctx"] = (f"CASE WHEN coalesce(htf_ema_alignment, 0) * {s} > 0 THEN 'htf_aligned_{'long' if long else 'short'}' WHEN coalesce(htf_ema_alignment, 0) <> 0 THEN 'htf_mixed' WHEN structure_state = {s} THEN 'structure_aligned' "
                "WHEN structure_state = 0 THEN 'structure_neutral' ELSE 'structure_mixed' END")
    q["ob"], q["br"] = ob, br
    return q


def _plus(base, *parts):
    return f"{base} + " + " + ".join(f"CASE WHEN {k} THEN {v} ELSE 0.0 END" for k, v in parts)


def _rules_sql(s):
    """setup -> (condition, confidence, anchor, stop, reference, reference type, sweep type, key, zone id)."""
    q = _side(s)
    lv, edge = "sweep_level_value", "lower" if s > 0 else "upper"
    out = {}
    for pre, tag in ((True, "pre"), (False, "post")):
        codes = ", ".join(map(str, su.OPEN_CODES[pre, s]))
        out[f"session_open_manipulation_{tag}_ib"] = (f"sweep_direction = {-s} AND is_rth AND {'NOT ' if pre else ''}ib_complete AND lunch_lull_flag = 0 AND close_ramp_flag = 0 AND sweep_level_code IN ({codes}) AND {lv} IS NOT NULL",
                                                      _plus("0.66", (q["disp"](3), 0.10), (f"(close - session_vwap) * {s} >= 0", 0.05), (q["pd"], 0.07)), lv, q["stop"](lv), lv, "level_name", q["sweep"], f"session_date || '|' || level_name || '|' || {lv}", "NULL")
    deep = _plus("0.0", (q["disp"](3), 0.08), (q["zone"], 0.08), (q["pd"], 0.07))
    out["sweep_reclaim"] = (f"sweep_direction = {-s} AND {lv} IS NOT NULL", f"0.52 + least(greatest(sweep_penetration_atr, 0.0), 1.5) / 20.0 + ({deep})", lv, q["stop"](lv), lv, "level_name", q["sweep"], f"level_name || '|' || {lv}", "NULL")
    held = f"close >= {q['lower']}" if s > 0 else f"close <= {q['upper']}"
    out["sweep_displacement_fvg"] = (f"{q['swept'](3)} AND {q['disp'](3)} AND {q['fvg']} AND {q['bydisp']} AND ({q['didx']} IS NULL OR bar_idx > {q['didx']}) AND {q['touch']} AND {held} AND {q['ref']} IS NOT NULL",
                                     _plus("0.67", (q["rev"], 0.08), (q["pd"], 0.08), (q["touch"], 0.06), (f"{q['dist']} <= 0.25", 0.05)), q["ce"], q["zstop"], q["ref"], q["rtype"], q["sweep"], f"CAST({q['id']} AS VARCHAR)", q["id"])
    ob, br = q["ob"], q["br"]
    out["ob_retest_after_mss"] = (f"{q['swept'](5)} AND {q['flip'](6)} AND {q['nm']}_order_block_retest_event = 1 AND structure_state IN (0, {s})", _plus("0.70", (q["mss"](6), 0.08), (q["zone"], 0.07), (q["pd"], 0.05)),
                                  f"({ob('lower')} + {ob('upper')}) / 2.0", q["stop"](ob(edge)), q["ref"], q["rtype"], q["sweep"], f"CAST({ob('id')} AS VARCHAR)", ob("id"))
    out_of = (lambda x: f"{x} >= {br('upper')}") if s > 0 else (lambda x: f"{x} <= {br('lower')}")
    mid, known = f"({br('lower')} + {br('upper')}) / 2.0", f"{q['ref']} IS NOT NULL"
    out["classic_breaker"] = (f"{q['nm']}_breaker_retest_event = 1 AND {br('lower')} < {br('upper')} AND {br('source_formed')} < {br('formed')} AND {br('formed')} < bar_idx AND {q['nm']}_breaker_age_bars BETWEEN 1 AND 120 AND {q['nm']}_breaker_retests = 1 "
                              f"AND {out_of('close')} AND (prev_close IS NULL OR {out_of('prev_close')})",
                              _plus("0.74", (q["mss"](6), 0.08), (f"{q['any']} AND {q['dist']} <= 0.5", 0.06), (q["pd"], 0.05), (f"dist_to_{q['nm']}_breaker_atr <= 0.25", 0.04)), mid, q["stop"](br(edge)), f"coalesce({q['ref']}, {mid})",
                              f"CASE WHEN {known} THEN {q['rtype']} ELSE 'classic_breaker_zone' END", f"CASE WHEN {known} THEN {q['sweep']} ELSE '' END", f"CAST({br('id')} AS VARCHAR)", br("id"))
    out["ifvg_reversal"] = (f"{q['ifvg']} AND bar_idx > nearest_{q['nm']}_fvg_inversion AND {q['touch']} AND (close - {q['ce']}) * {s} >= 0 AND {q['rev']}", _plus("0.73", (q["pd"], 0.08), (f"{q['dist']} <= 0.2", 0.06)), q["ce"], q["zstop"], q["ce"],
                            "'ifvg_ce'", "''", f"CAST({q['id']} AS VARCHAR)", q["id"])
    ostop = q["stop"](q["origin"])
    wide = f"CASE WHEN {q['origin']} IS NULL THEN {q['zstop']} WHEN {q['zstop']} IS NULL THEN {ostop} ELSE {'least' if s > 0 else 'greatest'}({q['zstop']}, {ostop}) END"
    out["premium_discount_continuation"] = (f"{q['trend']} AND {q['pd']} AND NOT {q['cflip']} AND {q['zone']} AND {q['dist']} <= 0.75", _plus("0.61", ("in_entry_band = 1", 0.11), (f"{q['dist']} <= 0.25", 0.08), (q["same"], 0.06)), q["ce"], wide, q["target"],
                                            "'dol'", "''", f"{q['fvg']} || '|' || {q['id']}", q["id"])
    out["displacement_continuation_after_raid"] = (f"{q['trend']} AND {q['swept'](8)} AND {q['disp'](3)} AND {q['zone']} AND close {q['cmp']} {q['origin']}", _plus("0.64", (f"{q['dist']} <= 0.35", 0.10), (q["pd"], 0.08), ("disp_score >= 1.0", 0.06)),
                                                   q["origin"], ostop, q["ref"], q["rtype"], q["sweep"], f"CAST({q['didx']} AS VARCHAR)", q["id"])
    return {n: (*r, q["target"], q["ctx"]) for n, r in out.items()}


def _long_sql():
    """One row a bar and setup, the long side first."""
    parts = []
    for s in (1, -1):
        for n, fam, pr, gap, lane in su.SETUPS:
            k, conf, anchor, stop, ref, rt, sw, key, zid, target, ctx = _rules_sql(s)[n]
            parts.append(f"SELECT symbol, bar_idx, session_date, {s} AS side, '{lane}' AS lane, {pr} AS priority, {gap} AS gap, '{n}' AS setup_type, '{fam}' AS setup_family, least(greatest({conf}, 0.0), 1.0) AS confidence, CAST({anchor} AS DOUBLE) AS anchor_level, "
                         f"{stop} AS stop_reference, {target} AS target_reference, CAST({ref} AS DOUBLE) AS reference_level, {rt} AS reference_level_type, {sw} AS sweep_type, {ctx} AS htf_context, CAST({zid} AS BIGINT) AS zone_id, '{n}|{s}|' || coalesce({key}, '') AS key FROM x WHERE {k}")
    return " UNION ALL ".join(parts)


CANDS = f"WITH x AS MATERIALIZED ({SETUP_IN}), u AS MATERIALIZED ({_long_sql()}) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol, bar_idx, setup_type ORDER BY side DESC) = 1"
_OK = f"""(NOT list_contains(list_transform(list_filter(r.fires, lambda f: f.key = z.key AND e.bar_idx - f.bar < z.gap), lambda f: f.key), z.key)) AND (CASE WHEN e.session_date IS DISTINCT FROM r.session_date THEN 0 WHEN z.side > 0 THEN r.longs ELSE r.shorts END) < {su.MOST_PER_SIDE}"""
FIRED = f"""WITH RECURSIVE cd AS MATERIALIZED ({CANDS}),
 fresh AS (SELECT * FROM cd a WHERE NOT EXISTS (SELECT 1 FROM cd b WHERE b.symbol = a.symbol AND b.lane = a.lane AND b.bar_idx = a.bar_idx - 1 AND b.key = a.key)),
 e AS MATERIALIZED (SELECT symbol, lane, bar_idx, session_date, list({{'key': key, 'gap': gap, 'side': side, 'priority': priority}} ORDER BY priority) AS zs, row_number() OVER (PARTITION BY symbol, lane ORDER BY bar_idx) AS n FROM fresh GROUP BY 1, 2, 3, 4),
 r AS (SELECT symbol, lane, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bar_idx, CAST(NULL AS DATE) AS session_date, CAST([] AS STRUCT(key VARCHAR, bar BIGINT)[]) AS fires, 0 AS longs, 0 AS shorts, CAST(NULL AS INTEGER) AS priority FROM e WHERE n = 1
 UNION ALL SELECT symbol, lane, n, bar_idx, session_date, CASE WHEN pick IS NULL THEN fires ELSE list_append(list_filter(fires, lambda f: bar_idx - f.bar < {su.LONGEST_SPACING}), {{'key': pick.key, 'bar': bar_idx}}) END,
 CASE WHEN new THEN 0 ELSE longs END + CASE WHEN pick.side > 0 THEN 1 ELSE 0 END, CASE WHEN new THEN 0 ELSE shorts END + CASE WHEN pick.side < 0 THEN 1 ELSE 0 END, pick.priority FROM (
 SELECT e.symbol, e.lane, e.n, e.bar_idx, e.session_date, r.fires, r.longs, r.shorts, e.session_date IS DISTINCT FROM r.session_date AS new, list_filter(e.zs, lambda z: {_OK})[1] AS pick FROM r JOIN e ON e.symbol = r.symbol AND e.lane = r.lane AND e.n = r.n + 1))
 SELECT cd.* FROM r JOIN cd ON cd.symbol = r.symbol AND cd.lane = r.lane AND cd.bar_idx = r.bar_idx AND cd.priority = r.priority"""
NAMES = [n for n, *_ in su.SETUPS]


@query("dt12_structure_setups", KEY + "lane:s setup_type:s setup_family:s setup_side:l " + FIELDS, f"SELECT *, side AS setup_side FROM ({FIRED})")
def _(m):
    return su.admitted(setups_t(m)).withColumnRenamed("side", "setup_side")


@query("dt12_setup_candidates", KEY + " ".join(f"side_{i}:l conf_{i} anchor_{i} stop_{i}" for i in range(9)) + " htf_ema_alignment:l",
       f"SELECT h.symbol, h.bar_idx, h.htf_ema_alignment, {', '.join(f'any_value({x}) FILTER (priority = {i}) AS {n}_{i}' for i in range(9) for n, x in (('side', 'side'), ('conf', 'confidence'), ('anchor', 'anchor_level'), ('stop', 'stop_reference')))} FROM ({QUERIES['ff11_htf_context'].sql}) h LEFT JOIN ({CANDS}) k ON k.symbol = h.symbol AND k.bar_idx = h.bar_idx GROUP BY 1, 2, 3")
def _(m):
    d = setups_t(m)
    return d.withColumns({f"{n}_{p}": c(f"cand_{name}.{x}") for name, _, p, *_ in su.SETUPS for n, x in (("side", "side"), ("conf", "confidence"), ("anchor", "anchor_level"), ("stop", "stop_reference"))})

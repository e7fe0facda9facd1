"""Price-structure detectors: swings and pools, reference levels, sweeps, displacement, structure breaks, gap zones, order blocks.

Zones are a long table (one row per zone). Their life is the bounded run of bars after birth, joined by position; counts and nearest
zones come back to the bars by aggregation. Only the structure-break state machine needs a per-bar kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag, safe_div
from barloom.operators import features as ff
from barloom.operators.blocks import BLOCK_ROWS, Frame, blocked, carry_last, chained, number_rows, spread
from barloom.operators.calendars import equity_session, phase_code
from barloom.operators.relate import path

TICK, MAX_AGE, SWING = 0.25, 120, 3


def with_swings(bars: DataFrame, n: int = SWING) -> DataFrame:
    """ATR, confirmed swings, their latest levels with pivot positions, and the price given up while waiting for confirmation."""
    def build(d, w):
        d = ff.volatility(d, w)
        d = ff.swings(d, w, n).drop("latest_swing_high", "latest_swing_low")
        hi, lo = c("swing_high_level").isNotNull(), c("swing_low_level").isNotNull()
        return d.withColumns({"_hp": F.when(hi, c("bar_idx") - n), "_lp": F.when(lo, c("bar_idx") - n),
                              "high_tax_atr": safe_div(c("swing_high_level") - c("close"), "atr_14"),
                              "low_tax_atr": safe_div(c("close") - c("swing_low_level"), "atr_14")})
    d = blocked(bars, build, before=70)
    d = carry_last(d, {"latest_swing_high": c("swing_high_level"), "latest_swing_low": c("swing_low_level"),
                       "latest_high_idx": c("_hp"), "latest_low_idx": c("_lp"), "atr_fill": c("atr_14")}).drop("_hp", "_lp")
    return d.withColumns({
        "atr_fill": F.coalesce("atr_fill", F.lit(0.0)), "atr_pos": F.when(c("atr_fill") > 0, c("atr_fill")).otherwise(1.0),
        "latest_high_dist_atr": safe_div(c("latest_swing_high") - c("close"), "atr_14"),
        "latest_low_dist_atr": safe_div(c("close") - c("latest_swing_low"), "atr_14")})


def zone_distance(price: Column, lower: Column, upper: Column) -> Column:
    return F.when(price < lower, lower - price).when(price > upper, price - upper).otherwise(0.0)


def zone_life(zones: DataFrame, bars: DataFrame, values=("high", "low", "close"), max_age: int = MAX_AGE) -> tuple[DataFrame, Window]:
    """Zone x bar rows from birth to ``max_age`` and the per-zone frame up to the current bar (bounded by ``max_age``)."""
    rows = path(zones, bars, c("born"), c("born") + max_age, values)
    w = Window.partitionBy("symbol", "zone_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows, w


def pools(d: DataFrame, n: int = SWING, tolerance: float = 0.2) -> DataFrame:
    """Near-equal consecutive swings form a pool that lives until pierced or too old."""
    base = d.withColumn("_tol", c("atr_pos") * tolerance)
    prev = carry_last(base, {
        "_ph": F.when(c("swing_high_level").isNotNull(), F.struct(c("swing_high_level").alias("lv"), c("bar_idx").alias("i"), c("_tol").alias("tol"))),
        "_pl": F.when(c("swing_low_level").isNotNull(), F.struct(c("swing_low_level").alias("lv"), c("bar_idx").alias("i"), c("_tol").alias("tol")))}, strict=True)
    parts = []
    for side, level, p in ((1, "swing_high_level", "_ph"), (-1, "swing_low_level", "_pl")):
        tol = F.greatest("_tol", c(p)["tol"])
        near = prev.filter((c(level) >= 0) & (c("bar_idx") - c(p)["i"] >= n) & (F.abs(c(level) - c(p)["lv"]) <= tol))
        mid = (c(level) + c(p)["lv"]) / 2.0
        parts.append(near.select("symbol", c("bar_idx").alias("born"), (c("bar_idx") * 2 + (0 if side == 1 else 1)).alias("zone_id"), F.lit(side).alias("side"),
                                 (mid - tol).alias("lower"), (mid + tol).alias("upper"), mid.alias("mid")))
    return parts[0].unionByName(parts[1])


def pool_context(d: DataFrame) -> DataFrame:
    rows, w = zone_life(pools(d), d)
    pierced = (c("step") > 0) & F.when(c("side") == 1, c("p_high") > c("upper")).otherwise(c("p_low") < c("lower"))
    live = rows.withColumn("_dead", F.max(flag(pierced)).over(w)).filter("_dead = 0")
    dist = zone_distance(c("p_close"), c("lower"), c("upper"))
    near = F.struct(dist.alias("dist"), c("born"), c("mid"))
    aggs = []
    for side, nm in ((1, "high"), (-1, "low")):
        on = c("side") == side
        aggs += [F.sum(flag(on)).alias(f"active_equal_{nm}_pool_count"), F.min(F.when(on, near)).alias(f"_{nm}")]
    stats = live.groupBy("symbol", c("path_idx").alias("bar_idx")).agg(*aggs)
    out = d.join(stats, ["symbol", "bar_idx"], "left")
    cols = {}
    for nm in ("high", "low"):
        cols |= {f"dist_to_equal_{nm}_pool_atr": c(f"_{nm}")["dist"] / c("atr_pos"), f"equal_{nm}_pool_age_bars": c("bar_idx") - c(f"_{nm}")["born"],
                 f"equal_{nm}_pool_level": c(f"_{nm}")["mid"], f"active_equal_{nm}_pool_count": F.coalesce(f"active_equal_{nm}_pool_count", F.lit(0))}
    return out.withColumns(cols).drop("_high", "_low")


REFERENCE = ["prior_rth_high", "prior_rth_low", "prior_rth_close", "overnight_high", "overnight_low", "rth_open", "ib_high", "ib_low", "prior_week_high",
             "prior_week_low", "midnight_open", "open_0830", "session_vwap", "rth_vwap"]


def reference_levels(bars: DataFrame) -> DataFrame:
    """Session and week reference levels. Windows stay inside one (symbol, session); priors come from the small session table."""
    d = phase_code(equity_session(bars))
    w = Window.partitionBy("symbol", "session_date").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("symbol", "local_date").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    rth, ovn, ib = c("is_rth"), c("is_overnight"), c("is_ib")
    typ = (c("high") + c("low") + c("close")) / 3.0
    rvol = F.when(rth, c("volume")).otherwise(0.0)
    ratio = lambda a, b: F.when(b != 0, a / b)
    week = F.next_day(F.date_sub("session_date", 1), "FRI")
    d = d.withColumn("week_key", week)
    per = d.groupBy("symbol", "session_date", "week_key").agg(
        F.max(F.when(rth, c("high"))).alias("_rh"), F.min(F.when(rth, c("low"))).alias("_rl"), F.max_by(F.when(rth, c("close")), F.when(rth, c("bar_idx"))).alias("_rc"),
        F.max(F.when(ovn, c("high"))).alias("_oh"), F.min(F.when(ovn, c("low"))).alias("_ol"), F.max(F.when(ib, c("high"))).alias("_ih"), F.min(F.when(ib, c("low"))).alias("_il"))
    back = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    prior = per.select("symbol", "session_date", "_oh", "_ol", "_ih", "_il", F.last("_rh", True).over(back).alias("prior_rth_high"),
                       F.last("_rl", True).over(back).alias("prior_rth_low"), F.last("_rc", True).over(back).alias("prior_rth_close"))
    wk = per.groupBy("symbol", "week_key").agg(F.max("_rh").alias("_wh"), F.min("_rl").alias("_wl"))
    wback = Window.partitionBy("symbol").orderBy("week_key").rowsBetween(Window.unboundedPreceding, -1)
    wk = wk.select("symbol", "week_key", F.last("_wh", True).over(wback).alias("prior_week_high"), F.last("_wl", True).over(wback).alias("prior_week_low"))
    d = d.withColumns({
        "_ohd": F.max(F.when(ovn, c("high"))).over(w), "_old": F.min(F.when(ovn, c("low"))).over(w),
        "ib_high_developing": F.when(ib, F.max(F.when(ib, c("high"))).over(w)), "ib_low_developing": F.when(ib, F.min(F.when(ib, c("low"))).over(w)),
        "rth_open": F.last(F.when(rth & (c("minutes_since_open") == 0), c("open")), True).over(w),
        "session_vwap": ratio(F.sum(typ * c("volume")).over(w), F.sum("volume").over(w)),
        "_rv": F.when(rth, ratio(F.sum(typ * rvol).over(w), F.sum(rvol).over(w))),
        "midnight_open": F.last(F.when(c("local_minute") == 0, c("open")), True).over(day),
        "open_0830": F.last(F.when(c("local_minute") == 510, c("open")), True).over(day)})
    d = d.withColumn("rth_vwap", F.last("_rv", True).over(w))
    d = d.join(prior, ["symbol", "session_date"]).join(wk, ["symbol", "week_key"])
    return d.withColumns({
        "overnight_high": F.when(ovn, c("_ohd")).otherwise(c("_oh")), "overnight_low": F.when(ovn, c("_old")).otherwise(c("_ol")),
        "ib_high": F.when(c("ib_complete"), c("_ih")), "ib_low": F.when(c("ib_complete"), c("_il")), "rth_gap_open": c("rth_open") - c("prior_rth_close"),
        "open_drive_flag": flag(rth & c("minutes_since_open").between(0, 29)), "lunch_lull_flag": flag(c("local_minute").between(720, 809)),
        "close_ramp_flag": flag(rth & (c("minutes_until_close") <= 60))}).drop(*[x for x in d.columns if x.startswith("_")])


# Sweep levels in priority order (later ones win a shared bar), direction +1 for buy-side.
SWEEP_LEVELS = [("latest_swing_high", 1, 1), ("equal_high_pool_level", 1, 2), ("prior_rth_high", 1, 3), ("overnight_high", 1, 4), ("ib_high", 1, 5), ("prior_week_high", 1, 6),
                ("latest_swing_low", -1, 11), ("equal_low_pool_level", -1, 12), ("prior_rth_low", -1, 13), ("overnight_low", -1, 14), ("ib_low", -1, 15), ("prior_week_low", -1, 16)]


def sweeps(d: DataFrame, reclaim: int = 1, levels=SWEEP_LEVELS) -> DataFrame:
    """Pierce and close back within ``reclaim`` bars. The event sits on the reclaiming bar; a failed pierce is known only then (look-ahead free)."""
    def build(r, w):
        buf = F.greatest(F.coalesce("atr_14", F.lit(0.0)) * 0.05, F.lit(TICK))
        cands, fails = [], {1: [], -1: []}
        pen_at = lambda lv, s: F.greatest(((c("high") - c(lv)) if s == 1 else (c(lv) - c("low"))) / F.greatest("atr_fill", F.lit(1e-6)), F.lit(0.0))
        pre = {}
        for k, (lv, s, code) in enumerate(levels):
            hit = (c("high") >= c(lv) + buf) if s == 1 else (c("low") <= c(lv) - buf)
            pre[f"_p{k}"] = F.when(hit, F.struct(c(lv).alias("lv"), pen_at(lv, s).alias("pen")))
        r = r.withColumns(pre)
        for k, (lv, s, code) in enumerate(levels):
            back = lambda x: (x < p["lv"]) if s == 1 else (x > p["lv"])
            for delay in range(reclaim, -1, -1):
                p = w.lag(f"_p{k}", delay) if delay else c(f"_p{k}")
                held = F.lit(True)
                for j in range(delay, 0, -1):
                    held = held & ~back(w.lag("close", j))
                cands.append(F.when(p.isNotNull() & held & back(c("close")), F.struct(F.lit(k).alias("k"), F.lit(-delay).alias("nd"), F.lit(code).alias("code"),
                                                                                   F.lit(s).alias("dir"), p["pen"].alias("pen"), p["lv"].alias("lv"))))
            p = w.lag(f"_p{k}", reclaim)
            held = F.lit(True)
            for j in range(reclaim, 0, -1):
                held = held & ~back(w.lag("close", j))
            fails[s].append(p.isNotNull() & held & ~back(c("close")))
        arr = F.array_compact(F.array(*cands))
        best = F.array_max(arr)
        anyof = lambda xs: F.array_max(F.array(*[F.coalesce(x, F.lit(False)) for x in xs])).cast("int")
        r = r.withColumns({"_best": best, "failed_buy_side_sweep": anyof(fails[1]), "failed_sell_side_sweep": anyof(fails[-1]),
                           "buy_side_sweep": flag(F.exists(arr, lambda x: x["dir"] == 1)), "sell_side_sweep": flag(F.exists(arr, lambda x: x["dir"] == -1))})
        return r.withColumns({
            "sweep_any": flag(c("_best").isNotNull()), "sweep_level_code": F.coalesce(c("_best")["code"], F.lit(0)), "sweep_penetration_atr": c("_best")["pen"],
            "sweep_reclaim_bars": -c("_best")["nd"], "sweep_level_value": c("_best")["lv"], "sweep_direction": F.coalesce(c("_best")["dir"], F.lit(0))}).drop("_best", *pre)
    r = blocked(d, build, before=reclaim + 1)
    r = carry_last(r, {"_b": F.when(c("buy_side_sweep") == 1, c("bar_idx")), "_s": F.when(c("sell_side_sweep") == 1, c("bar_idx"))})
    return r.withColumns({"since_buy_sweep": c("bar_idx") - c("_b"), "since_sell_sweep": c("bar_idx") - c("_s"),
                          "since_sweep_any": c("bar_idx") - F.greatest("_b", "_s")}).drop("_b", "_s")


def displacement(d: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Large one-sided bars with volume confirmed against earlier bars of the same session phase, however far back those lie."""
    def build(r, _):
        g = Frame(("symbol", "phase_code", "block"), "_nth")
        w50, w20 = g.rows(-50, -1), g.rows(-20, -1)
        sd = F.stddev_samp("volume").over(w50)
        mean20 = F.when(F.count("volume").over(w20) >= 5, F.avg("volume").over(w20))
        rng, body = c("high") - c("low"), F.abs(c("close") - c("open"))
        same = F.min("volume").over(w50) == F.max("volume").over(w50)
        return r.withColumns({
            "volume_phase_z": F.when((F.count("volume").over(w50) >= 20) & ~same & (sd != 0), (c("volume") - F.avg("volume").over(w50)) / sd),
            "volume_phase_rel": safe_div("volume", mean20), "disp_body_to_range": safe_div(body, rng, 0.0), "disp_range_atr": safe_div(rng, "atr_14", 0.0),
            "disp_close_location": safe_div(c("close") - c("low"), rng, 0.5)})
    r = number_rows(d, keys=("symbol", "phase_code"), name="_nth")
    r = build(spread(r, 50, 0, size, "_nth"), None).filter("own").drop("block", "own", "_nth")
    strong = (c("disp_range_atr") >= 1.5) & (c("disp_body_to_range") >= 0.65) & F.coalesce(c("volume_phase_z") >= 0.5, F.lit(False))
    up, dn = (c("close") > c("open")) & strong & (c("disp_close_location") >= 0.75), (c("close") < c("open")) & strong & (c("disp_close_location") <= 0.25)
    score = (c("disp_range_atr") * 0.45 + c("disp_body_to_range") * 0.25 + F.greatest(F.coalesce("volume_phase_z", F.lit(0.0)), F.lit(0.0)) / 3.0 * 0.20
             + F.abs(c("disp_close_location") - 0.5) * 2.0 * 0.10)
    r = r.withColumns({"disp_score": score, "disp_bull": flag(up), "disp_bear": flag(dn)})
    r = carry_last(r, {"latest_bull_disp_idx": F.when(c("disp_bull") == 1, c("bar_idx")), "latest_bear_disp_idx": F.when(c("disp_bear") == 1, c("bar_idx")),
                       "latest_bull_disp_origin": F.when(c("disp_bull") == 1, c("low")), "latest_bear_disp_origin": F.when(c("disp_bear") == 1, c("high"))})
    return r.withColumns({"since_disp_bull": c("bar_idx") - c("latest_bull_disp_idx"), "since_disp_bear": c("bar_idx") - c("latest_bear_disp_idx")})


def _structure(pdf, state):
    """Trend over breaks of the latest confirmed swings; each swing level breaks once. Only bars beyond a level are visited."""
    trend, *seen = state
    high, low, top, bottom, buf = (pdf[x].to_numpy(float) for x in ("high", "low", "latest_swing_high", "latest_swing_low", "_buf"))
    swept = {1: pdf["_rs"].to_numpy(bool), -1: pdf["_rb"].to_numpy(bool)}
    beyond = {1: high > top + buf, -1: low < bottom - buf}
    levels, kind, level = {1: top, -1: bottom}, np.zeros(len(pdf), int), np.full(len(pdf), np.nan)
    for i in np.flatnonzero(beyond[1] | beyond[-1]).tolist():
        for side, k in ((1, 0), (-1, 1)):
            x = levels[side][i]
            if beyond[side][i] and not abs(x - seen[k]) <= buf[i] / 2.0:
                kind[i] = side * (1 if trend != -side else 3 if swept[side][i] else 2)
                level[i], trend, seen[k] = x, side, x
                break
    last = pd.Series(np.where(kind != 0, np.sign(kind), np.nan)).ffill().fillna(state[0])
    return {"break_kind": kind, "structure_state": last.to_numpy(int), "structure_break_level": level}, [trend, *seen]


def structure_breaks(d: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """BOS (kind 1), CHoCH (2) and sweep-confirmed shift (3), positive when bullish; the state runs through the whole history."""
    src = d.withColumns({"_buf": F.greatest(F.coalesce("atr_14", F.lit(0.0)) * 0.05, F.lit(TICK)),
                         "_rs": F.coalesce(c("since_sell_sweep") <= 3, F.lit(False)), "_rb": F.coalesce(c("since_buy_sweep") <= 3, F.lit(False))})
    k = chained(src, _structure, [0.0, float("nan"), float("nan")], "break_kind int, structure_state int, structure_break_level double",
                ["high", "low", "latest_swing_high", "latest_swing_low", "_buf", "_rs", "_rb"], size)
    b = d.join(k, ["symbol", "bar_idx"])
    b = b.withColumn("structure_break_level", F.when(~F.isnan("structure_break_level"), c("structure_break_level")))
    kk = c("break_kind")
    return b.withColumns({"bos_bull": flag(kk == 1), "bos_bear": flag(kk == -1), "choch_bull": flag(kk >= 2), "choch_bear": flag(kk <= -2),
                          "mss_bull": flag(kk == 3), "mss_bear": flag(kk == -3)})


def gap_zones(d: DataFrame, min_gap: float = 0.15) -> DataFrame:
    """Three-bar gaps wider than both a fraction of ATR and a tick."""
    g = blocked(d, lambda r, w: r.withColumns({"_h2": w.lag("high", 2), "_l2": w.lag("low", 2)}), before=2)
    need = F.greatest(F.coalesce("atr_14", F.lit(0.0)) * min_gap, F.lit(TICK))
    mk = lambda side, lo, up, by: g.select("symbol", c("bar_idx").alias("born"), (c("bar_idx") * 2 + (0 if side == 1 else 1)).alias("zone_id"), F.lit(side).alias("side"),
                                           lo.alias("lower"), up.alias("upper"), ((lo + up) / 2.0).alias("ce"), c(by).alias("by_disp"), need.alias("need"))
    z = mk(1, c("_h2"), c("low"), "disp_bull").unionByName(mk(-1, c("high"), c("_l2"), "disp_bear"))
    return z.filter(c("upper") - c("lower") > c("need")).drop("need")


def gap_life(zones: DataFrame, d: DataFrame) -> DataFrame:
    """Zone x bar state: current direction (last close beyond the zone decides), inversion, mitigation, mid tap."""
    rows, w = zone_life(zones, d)
    later = c("step") > 0
    sig = F.when(later & (c("p_close") < c("lower")), -1).when(later & (c("p_close") > c("upper")), 1)
    rows = rows.withColumns({"_sig": sig, "_ov": F.when(later, F.greatest(F.least("p_high", "upper") - F.greatest("p_low", "lower"), F.lit(0.0))).otherwise(0.0)})
    prev = Window.partitionBy("symbol", "zone_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_before": F.coalesce(F.last("_sig", True).over(prev), c("side")), "dir": F.coalesce(F.last("_sig", True).over(w), c("side")),
                             "mitigation": F.max(c("_ov") / F.greatest(c("upper") - c("lower"), F.lit(TICK))).over(w),
                             "ce_tapped": F.max(flag((c("_ov") > 0) & (c("p_low") <= c("ce")) & (c("ce") <= c("p_high")))).over(w)})
    flip = c("_sig") != c("_before")
    return rows.withColumns({"inverted": F.max(flag(flip)).over(w), "inversion_idx": F.last(F.when(flip, c("path_idx")), True).over(w)}).drop("_sig", "_before", "_ov")


def gap_context(d: DataFrame) -> DataFrame:
    live = gap_life(gap_zones(d), d)
    near = F.struct(zone_distance(c("p_close"), c("lower"), c("upper")).alias("dist"), "born", c("zone_id"), "lower", "upper", "ce", "mitigation", "ce_tapped", "inverted",
                    "inversion_idx", "by_disp")
    aggs = []
    for s, nm in ((1, "bull"), (-1, "bear")):
        on = c("dir") == s
        aggs += [F.sum(flag(on)).alias(f"active_{nm}_fvg_count"), F.sum(flag(on & (c("inverted") == 1))).alias(f"active_{nm}_ifvg_count"), F.min(F.when(on, near)).alias(f"_{nm}")]
    st = live.groupBy("symbol", c("path_idx").alias("bar_idx")).agg(*aggs)
    out = d.join(st, ["symbol", "bar_idx"], "left")
    cols = {}
    for nm in ("bull", "bear"):
        z = c(f"_{nm}")
        cols |= {f"active_{nm}_fvg_count": F.coalesce(f"active_{nm}_fvg_count", F.lit(0)), f"active_{nm}_ifvg_count": F.coalesce(f"active_{nm}_ifvg_count", F.lit(0)),
                 f"dist_to_{nm}_fvg_atr": z["dist"] / c("atr_pos"), f"dist_to_{nm}_fvg_ce_atr": F.abs(c("close") - z["ce"]) / c("atr_pos"),
                 f"inside_{nm}_fvg": flag(z["dist"] == 0), f"{nm}_fvg_ce_tapped": F.coalesce(z["ce_tapped"], F.lit(0)),
                 f"nearest_{nm}_is_ifvg": F.coalesce(z["inverted"], F.lit(0)), f"{nm}_fvg_mitigation": z["mitigation"], f"nearest_{nm}_fvg_lower": z["lower"],
                 f"nearest_{nm}_fvg_upper": z["upper"], f"nearest_{nm}_fvg_formed": z["born"], f"nearest_{nm}_fvg_inversion": z["inversion_idx"],
                 f"nearest_{nm}_fvg_id": z["zone_id"], f"nearest_{nm}_fvg_ce": z["ce"], f"nearest_{nm}_fvg_by_disp": F.coalesce(z["by_disp"], F.lit(0))}
    return out.withColumns(cols).drop("_bull", "_bear")


def _block_life(zones: DataFrame, d: DataFrame, extra=()) -> DataFrame:
    rows, w = zone_life(zones, d, ("high", "low", "close", *extra))
    broke = (c("step") > 0) & F.when(c("side") == 1, c("p_close") < c("lower") - TICK).otherwise(c("p_close") > c("upper") + TICK)
    rows = rows.withColumn("_dead", F.sum(flag(broke)).over(w))
    touch = (c("step") > 0) & (c("_dead") == 0) & (c("p_high") >= c("lower")) & (c("p_low") <= c("upper"))
    return rows.withColumns({"touch": flag(touch), "retests": F.sum(flag(touch)).over(w), "died_here": flag(broke & (c("_dead") == 1))})


def order_blocks(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order-block and breaker zones: last opposite candle before a displaced break; a failed block with shift and sweep turns breaker."""
    g = blocked(d, lambda r, w: r.withColumns({"_o1": w.lag("open"), "_c1": w.lag("close")}), before=1)
    up = g.filter((c("disp_bull") == 1) & ((c("bos_bull") == 1) | (c("choch_bull") == 1)) & (c("_c1") < c("_o1"))).withColumn("side", F.lit(1))
    dn = g.filter((c("disp_bear") == 1) & ((c("bos_bear") == 1) | (c("choch_bear") == 1)) & (c("_c1") > c("_o1"))).withColumn("side", F.lit(-1))
    z = up.unionByName(dn).select("symbol", c("bar_idx").alias("born"), (c("bar_idx") * 2 + flag(c("side") < 0)).alias("zone_id"), "side", F.least("_o1", "_c1").alias("lower"),
                                  F.greatest("_o1", "_c1").alias("upper"), c("disp_score").alias("score"))
    ok = d.withColumns({"shift_dn": flag((c("disp_bear") == 1) & (c("choch_bear") == 1) & (c("since_buy_sweep") <= 5)),
                        "shift_up": flag((c("disp_bull") == 1) & (c("choch_bull") == 1) & (c("since_sell_sweep") <= 5))})
    life = _block_life(z, ok, ("shift_dn", "shift_up"))
    turned = life.filter((c("died_here") == 1) & F.when(c("side") == 1, c("p_shift_dn") == 1).otherwise(c("p_shift_up") == 1))
    breakers = turned.select("symbol", c("path_idx").alias("born"), c("zone_id").alias("source_id"), c("born").alias("source_born"), (c("zone_id") + c("path_idx") * 1000003).alias("zone_id"),
                             (-c("side")).alias("side"), "lower", "upper", "score")
    return life, breakers


def block_context(d: DataFrame) -> DataFrame:
    life, breakers = order_blocks(d)
    out = d
    for nm, rows in (("order_block", life), ("breaker", _block_life(breakers, d))):
        source = c("source_born") if nm == "breaker" else F.lit(None).cast("long").alias("source_born")
        near = F.struct(zone_distance(c("p_close"), c("lower"), c("upper")).alias("dist"), "born", "zone_id", "lower", "upper", "retests", "touch", source)
        aggs = []
        for s, sd in ((1, "bull"), (-1, "bear")):
            on = c("side") == s
            aggs += [F.sum(flag(on)).alias(f"active_{sd}_{nm}_count"), F.min(F.when(on, near)).alias(f"_{sd}")]
        st = rows.filter("_dead = 0").groupBy("symbol", c("path_idx").alias("bar_idx")).agg(*aggs)
        out = out.join(st, ["symbol", "bar_idx"], "left")
        cols = {}
        for sd in ("bull", "bear"):
            z = c(f"_{sd}")
            cols |= {f"active_{sd}_{nm}_count": F.coalesce(f"active_{sd}_{nm}_count", F.lit(0)), f"dist_to_{sd}_{nm}_atr": z["dist"] / c("atr_pos"),
                     f"{sd}_{nm}_age_bars": c("bar_idx") - z["born"], f"{sd}_{nm}_retests": z["retests"], f"{sd}_{nm}_retest_event": F.coalesce(z["touch"], F.lit(0)),
                     f"nearest_{sd}_{nm}_lower": z["lower"], f"nearest_{sd}_{nm}_upper": z["upper"], f"nearest_{sd}_{nm}_id": z["zone_id"], f"nearest_{sd}_{nm}_formed": z["born"]}
            if nm == "breaker":
                cols[f"nearest_{sd}_breaker_source_formed"] = z["source_born"]
        out = out.withColumns(cols).drop("_bull", "_bear")
    return out


def premium_discount(d: DataFrame) -> DataFrame:
    """Position in the dealing range, retracement band 0.62-0.79 and the nearest liquidity above and below."""
    hi, lo = c("latest_swing_high"), c("latest_swing_low")
    d = d.withColumns({"range_low": F.least(hi, lo), "range_high": F.greatest(hi, lo)})
    size = c("range_high") - c("range_low")
    d = d.withColumns({"range_pct": safe_div(c("close") - c("range_low"), F.when(hi.isNotNull() & lo.isNotNull(), size)),
                       "impulse_direction": F.when(c("latest_high_idx") > c("latest_low_idx"), 1).when(c("latest_low_idx") > c("latest_high_idx"), -1).otherwise(0)})
    retr = F.when(c("impulse_direction") == 1, safe_div(hi - c("close"), size)).when(c("impulse_direction") == -1, safe_div(c("close") - lo, size))
    ups = F.array(*[c(x) for x in ("prior_rth_high", "overnight_high", "ib_high", "prior_week_high", "equal_high_pool_level", "latest_swing_high")])
    dns = F.array(*[c(x) for x in ("prior_rth_low", "overnight_low", "ib_low", "prior_week_low", "equal_low_pool_level", "latest_swing_low")])
    d = d.withColumns({"retracement": retr, "dol_up": F.array_min(F.filter(ups, lambda x: x > c("close"))), "dol_down": F.array_max(F.filter(dns, lambda x: x < c("close")))})
    r = c("retracement")
    return d.withColumns({
        "discount_zone": flag(c("range_pct") < 0.5), "premium_zone": flag(c("range_pct") > 0.5), "in_entry_band": flag(r.between(0.62, 0.79)),
        "dist_to_band_mid": F.abs(r - 0.705), "band_bucket": F.when(r < 0.62, -1).when(r > 0.79, 1).otherwise(0),
        "dol_up_atr": safe_div(c("dol_up") - c("close"), "atr_14"), "dol_down_atr": safe_div(c("close") - c("dol_down"), "atr_14")})


def context(bars: DataFrame) -> DataFrame:
    """The whole stack in dependency order."""
    d = reference_levels(pool_context(with_swings(bars)))
    d = structure_breaks(displacement(sweeps(d)))
    d = premium_discount(block_context(gap_context(d)))
    near = lambda x: flag(c(x) <= 1.0)
    d = d.withColumns({"bull_confluence": near("dist_to_bull_fvg_atr") + near("dist_to_bull_order_block_atr") + near("dist_to_equal_low_pool_atr"),
                       "bear_confluence": near("dist_to_bear_fvg_atr") + near("dist_to_bear_order_block_atr") + near("dist_to_equal_high_pool_atr")})
    return d.withColumns({"total_confluence": c("bull_confluence") + c("bear_confluence"), "zone_balance": c("bull_confluence") - c("bear_confluence")})


def interactions(d: DataFrame) -> DataFrame:
    """Eleven conjunctions of the stack (needs price_position_50)."""
    b = lambda cond: F.coalesce(cond, F.lit(False))
    recent = b(c("since_sweep_any") <= SWING)
    near = {f"{s}_{z}": b(c(f"dist_to_{s}_{z}_atr") <= 1.0) for s in ("bull", "bear") for z in ("fvg", "order_block")}
    chb, chs, db, ds = (c(x) == 1 for x in ("choch_bull", "choch_bear", "disp_bull", "disp_bear"))
    disc, prem = b(c("price_position_50") <= 0.5), b(c("price_position_50") >= 0.5)
    return d.withColumns({k: flag(v) for k, v in {
        "bull_sweep_plus_fvg": recent & near["bull_fvg"], "bear_sweep_plus_fvg": recent & near["bear_fvg"],
        "bull_sweep_plus_ob": recent & near["bull_order_block"], "bear_sweep_plus_ob": recent & near["bear_order_block"],
        "bull_choch_after_sweep": recent & chb, "bear_choch_after_sweep": recent & chs, "sweep_plus_choch": recent & (chb | chs),
        "displacement_after_sweep": recent & (db | ds), "fvg_retrace_after_displacement": (db & near["bull_fvg"]) | (ds & near["bear_fvg"]),
        "bull_zone_in_discount": disc & (near["bull_fvg"] | near["bull_order_block"]), "bear_zone_in_premium": prem & (near["bear_fvg"] | near["bear_order_block"])}.items()})

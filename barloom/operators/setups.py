"""Rule setups on structure context: nine candidate rules a bar, an admission pass and one selected setup a lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators.blocks import BLOCK_ROWS, blocked, carry_last, chained
from barloom.operators.patterns import TICK

# Setup, family, priority (lower wins a bar), bars between two fires of one anchor, lane.
SETUPS = [
    ("session_open_manipulation_pre_ib", "reversal", 0, 60, "primary"),
    ("session_open_manipulation_post_ib", "reversal", 1, 60, "primary"),
    ("ifvg_reversal", "reversal", 2, 8, "primary"),
    ("ob_retest_after_mss", "reversal", 3, 8, "primary"),
    ("classic_breaker", "reversal", 4, 8, "research"),
    ("sweep_displacement_fvg", "reversal", 5, 6, "primary"),
    ("displacement_continuation_after_raid", "continuation", 6, 16, "primary"),
    ("premium_discount_continuation", "continuation", 7, 10, "primary"),
    ("sweep_reclaim", "reversal", 8, 6, "primary"),
]
# Names of sweep levels by code, and the codes that open-manipulation setups accept.
LEVEL_NAMES = {1: "swing_high", 2: "equal_high", 3: "prior_rth_high", 4: "overnight_high", 5: "ib_high", 6: "prior_week_high",
               11: "swing_low", 12: "equal_low", 13: "prior_rth_low", 14: "overnight_low", 15: "ib_low", 16: "prior_week_low"}
OPEN_CODES = {(True, 1): (13, 14), (True, -1): (3, 4), (False, 1): (15,), (False, -1): (5,)}
WINDOW, MOST_PER_SIDE, BREAKER_AGE = 3, 3, 120  #: confluence bars; fires a side and session; bars a breaker lives
LONGEST_SPACING = max(s for *_, s, _ in SETUPS)


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def within(name: str, bars: int) -> Column:
    return yes(c(name).between(0, bars))


def bonus(cond: Column, value: float) -> Column:
    return F.when(yes(cond), F.lit(value)).otherwise(0.0)


class Side:
    """What a bar's context says for one direction."""

    def __init__(self, side: int):
        long = side > 0
        self.side, nm = side, "bull" if long else "bear"
        other = "sell" if long else "buy"  # the sweep that a reversal follows
        self.recent_disp = lambda n: within(f"since_disp_{nm}", n)
        self.swept = lambda n: within(f"since_{other}_sweep", n)
        self.swept_same = lambda n: within(f"since_{'buy' if long else 'sell'}_sweep", n)
        self.mss = lambda n: within(f"since_mss_{nm}", n)
        self.flip = lambda n: within(f"since_choch_{nm}", n) | self.mss(n)
        self.origin, self.disp_idx = c(f"latest_{nm}_disp_origin"), c(f"latest_{nm}_disp_idx")
        self.aligned = yes((c("in_entry_band") == 1) | (c("discount_zone" if long else "premium_zone") == 1))
        self.ref, self.ref_type, self.sweep_type = c(f"last_{other}_level"), c(f"last_{other}_type"), F.lit(f"{other}_side")
        fvg, ob = c(f"dist_to_{nm}_fvg_atr"), c(f"dist_to_{nm}_order_block_atr")
        pick = fvg.isNotNull() & (ob.isNull() | (fvg <= ob))
        self.is_ifvg = yes(pick & (c(f"nearest_{nm}_is_ifvg") == 1))
        self.any_zone = pick | ob.isNotNull()
        self.zone = self.any_zone & ~self.is_ifvg
        self.kind = F.when(self.is_ifvg, "ifvg").when(pick, "fvg").otherwise("order_block")
        of = lambda a, b: F.when(pick, c(f"nearest_{nm}_fvg_{a}")).otherwise(b)
        lo, hi = c(f"nearest_{nm}_order_block_lower"), c(f"nearest_{nm}_order_block_upper")
        self.lower, self.upper, self.ce = of("lower", lo), of("upper", hi), of("ce", (lo + hi) / 2.0)
        self.zone_id, self.dist = of("id", c(f"nearest_{nm}_order_block_id")), F.when(pick, fvg).otherwise(ob)
        self.by_disp, self.inversion = yes(pick & (c(f"nearest_{nm}_fvg_by_disp") == 1)), c(f"nearest_{nm}_fvg_inversion")
        self.ob = {k: c(f"nearest_{nm}_order_block_{k}") for k in ("id", "lower", "upper")} | {"event": c(f"{nm}_order_block_retest_event") == 1}
        self.breaker = {k: c(f"nearest_{nm}_breaker_{k}") for k in ("id", "lower", "upper", "formed", "source_formed")} | {
            "event": c(f"{nm}_breaker_retest_event") == 1, "age": c(f"{nm}_breaker_age_bars"), "retests": c(f"{nm}_breaker_retests"), "dist": c(f"dist_to_{nm}_breaker_atr")}
        beyond = (lambda a, b: a > b) if long else (lambda a, b: a < b)
        self.beyond = lambda a, b: yes(beyond(a, b))
        draw, swing = c("dol_up" if long else "dol_down"), c("latest_swing_high" if long else "latest_swing_low")
        self.target = F.coalesce(F.when(beyond(draw, c("close")), draw), F.when(beyond(swing, c("close")), swing), c("close") + side * 2.0 * c("atr_14"))
        self.buffer = F.greatest(F.lit(TICK), F.coalesce(c("atr_14") * 0.25, F.lit(0.0)))
        self.stop = lambda level: level - side * self.buffer
        self.zone_stop = self.stop(self.lower if long else self.upper)
        self.state = c("structure_state")
        self.trend = F.when(F.coalesce("htf_ema_alignment", F.lit(0)) != 0, c("htf_ema_alignment") * side > 0).otherwise((self.state == side) & (c("impulse_direction") == side))
        self.reversal = (self.state == side) | self.flip(8)
        self.touches = yes((c("low") <= self.ce) & (self.ce <= c("high")))
        htf = F.coalesce("htf_ema_alignment", F.lit(0))
        self.context = (F.when(htf * side > 0, "htf_aligned_long" if long else "htf_aligned_short").when(htf != 0, "htf_mixed")
                        .when(self.state == side, "structure_aligned").when(self.state == 0, "structure_neutral").otherwise("structure_mixed"))


def _made(s: Side, name: str, when: Column, conf: Column, anchor: Column, stop: Column, ref: Column, ref_type: Column, sweep: Column, key: list[Column], zone: Column | None = None) -> Column:
    return F.when(yes(when), F.struct(
        F.lit(s.side).alias("side"), F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)).alias("confidence"), anchor.cast("double").alias("anchor_level"), stop.alias("stop_reference"), s.target.alias("target_reference"),
        ref.cast("double").alias("reference_level"), ref_type.alias("reference_level_type"), sweep.alias("sweep_type"), s.context.alias("htf_context"), (F.lit(None) if zone is None else zone).cast("long").alias("zone_id"),
        F.xxhash64(F.lit(name), F.lit(s.side), *key).alias("key")))


def _rules(side: int) -> dict[str, Column]:
    """Candidate of each setup for one direction, null where its rule does not hold."""
    s = Side(side)
    swept_now, level = c("sweep_direction") == -side, c("sweep_level_value")
    level_name = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv))[c("sweep_level_code")], F.lit(""))
    disc = bonus(s.aligned, 0.07)
    out = {}
    for pre in (True, False):
        name = f"session_open_manipulation_{'pre' if pre else 'post'}_ib"
        open_now = swept_now & c("is_rth").cast("boolean") & ((c("ib_complete").cast("int") == 0) if pre else (c("ib_complete").cast("int") == 1)) & (c("lunch_lull_flag") == 0) & (c("close_ramp_flag") == 0)
        react = (c("close") - c("session_vwap")) * side >= 0
        out[name] = _made(s, name, open_now & c("sweep_level_code").isin(*OPEN_CODES[pre, side]) & level.isNotNull(), F.lit(0.66) + bonus(s.recent_disp(3), 0.10) + bonus(react, 0.05) + disc, level, s.stop(level),
                          level, level_name, s.sweep_type, [c("session_date"), c("sweep_level_code"), level])
    depth = F.least(F.greatest(c("sweep_penetration_atr"), F.lit(0.0)), F.lit(1.5)) / 20.0
    out["sweep_reclaim"] = _made(s, "sweep_reclaim", swept_now & level.isNotNull(), F.lit(0.52) + depth + (bonus(s.recent_disp(WINDOW), 0.08) + bonus(s.zone, 0.08) + disc), level, s.stop(level), level, level_name,
                                 s.sweep_type, [c("sweep_level_code"), level])
    held = ~s.beyond(s.lower if side > 0 else s.upper, c("close"))
    out["sweep_displacement_fvg"] = _made(
        s, "sweep_displacement_fvg", s.swept(WINDOW) & s.recent_disp(WINDOW) & s.zone & (s.kind == "fvg") & s.by_disp & (s.disp_idx.isNull() | (c("bar_idx") > s.disp_idx)) & s.touches & held & s.ref.isNotNull(),
        F.lit(0.67) + bonus(s.reversal, 0.08) + bonus(s.aligned, 0.08) + bonus(s.touches, 0.06) + bonus(s.dist <= 0.25, 0.05), s.ce, s.zone_stop, s.ref, s.ref_type, s.sweep_type, [s.zone_id], s.zone_id)
    mid = lambda z: (z["lower"] + z["upper"]) / 2.0
    edge = lambda z: z["lower"] if side > 0 else z["upper"]
    out["ob_retest_after_mss"] = _made(s, "ob_retest_after_mss", s.swept(WINDOW + 2) & s.flip(max(WINDOW + 2, 6)) & s.ob["event"] & s.state.isin(0, side), F.lit(0.70) + bonus(s.mss(6), 0.08) + bonus(s.zone, 0.07) + bonus(s.aligned, 0.05),
                                       mid(s.ob), s.stop(edge(s.ob)), s.ref, s.ref_type, s.sweep_type, [s.ob["id"]], s.ob["id"])
    b = s.breaker
    outside = (lambda x: x >= b["upper"]) if side > 0 else (lambda x: x <= b["lower"])
    near = s.any_zone & (s.dist <= 0.5)
    out["classic_breaker"] = _made(
        s, "classic_breaker", b["event"] & (b["lower"] < b["upper"]) & (b["source_formed"] < b["formed"]) & (b["formed"] < c("bar_idx")) & b["age"].between(1, BREAKER_AGE) & (b["retests"] == 1) & outside(c("close"))
        & (c("prev_close").isNull() | outside(c("prev_close"))), F.lit(0.74) + bonus(s.mss(6), 0.08) + bonus(near, 0.06) + bonus(s.aligned, 0.05) + bonus(b["dist"] <= 0.25, 0.04), mid(b), s.stop(edge(b)),
        F.coalesce(s.ref, mid(b)), F.when(s.ref.isNotNull(), s.ref_type).otherwise("classic_breaker_zone"), F.when(s.ref.isNotNull(), s.sweep_type).otherwise(""), [b["id"]], b["id"])
    out["ifvg_reversal"] = _made(s, "ifvg_reversal", s.is_ifvg & (c("bar_idx") > s.inversion) & s.touches & ((c("close") - s.ce) * side >= 0) & s.reversal, F.lit(0.73) + bonus(s.aligned, 0.08) + bonus(s.dist <= 0.2, 0.06), s.ce, s.zone_stop,
                                 s.ce, F.lit("ifvg_ce"), F.lit(""), [s.zone_id], s.zone_id)
    counter = Side(-side)
    origin_stop = s.stop(s.origin)
    wide = F.coalesce((F.least if side > 0 else F.greatest)(s.zone_stop, origin_stop), origin_stop, s.zone_stop)
    out["premium_discount_continuation"] = _made(
        s, "premium_discount_continuation", s.trend & s.aligned & ~counter.flip(3) & s.zone & (s.dist <= 0.75), F.lit(0.61) + bonus(c("in_entry_band") == 1, 0.11) + bonus(s.dist <= 0.25, 0.08) + bonus(s.swept_same(8), 0.06), s.ce, wide,
        s.target, F.lit("dol"), F.lit(""), [s.kind, s.zone_id], s.zone_id)
    out["displacement_continuation_after_raid"] = _made(
        s, "displacement_continuation_after_raid", s.trend & s.swept(8) & s.recent_disp(WINDOW) & s.zone & s.beyond(c("close"), s.origin),
        F.lit(0.64) + bonus(s.dist <= 0.35, 0.10) + bonus(s.aligned, 0.08) + bonus(c("disp_score") >= 1.0, 0.06), s.origin, origin_stop, s.ref, s.ref_type, s.sweep_type, [s.disp_idx], s.zone_id)
    return out


def setup_inputs(d: DataFrame) -> DataFrame:
    """Context plus last swept levels, ages of structure shifts and the previous close. ``d``: structure context and ``htf_ema_alignment``."""
    name = F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv))[c("sweep_level_code")]
    on = lambda flag_, x: F.when(c(flag_) == 1, x)
    ages = {f"since_{k}_{s}": on(f"{k}_{s}", c("bar_idx")) for k in ("choch", "mss") for s in ("bull", "bear")}
    names = ["symbol", "bar_idx", "sweep_level_code", "sweep_level_value", "buy_side_sweep", "sell_side_sweep", "close", *(x.replace("since_", "") for x in ages)]
    far = carry_last(d.select(*names), {f"last_{s}_{k}": on(f"{s}_side_sweep", F.coalesce(v, F.lit("")) if k == "type" else v) for s in ("buy", "sell") for k, v in (("level", c("sweep_level_value")), ("type", name))} | ages)
    far = far.withColumns({k: c("bar_idx") - c(k) for k in ages} | {f"last_{s}_type": F.coalesce(f"last_{s}_type", F.lit("")) for s in ("buy", "sell")})
    far = blocked(far, lambda r, w: r.withColumn("prev_close", w.lag("close")), before=1)
    return d.join(far.select("symbol", "bar_idx", "prev_close", *ages, *(f"last_{s}_{k}" for s in ("buy", "sell") for k in ("level", "type"))), ["symbol", "bar_idx"])


def candidates(d: DataFrame) -> DataFrame:
    """``d`` with one struct column a setup, ``cand_<setup>``; the long side is asked first."""
    long, short = _rules(1), _rules(-1)
    return d.withColumns({f"cand_{name}": F.coalesce(long[name], short[name]) for name, *_ in SETUPS})


def _admission(p, state):
    """One fire a bar by priority: not within an anchor's spacing, at most ``MOST_PER_SIDE`` a side and session. The state is the session, its two
    counts, the last bar that fired and the anchors that fired within the longest spacing."""
    session, longs, shorts, taken, *rest = state
    last, fired = dict(zip(rest[::2], rest[1::2])), []
    for bar, day, side, key, gap in zip(*(p[x].tolist() for x in ("bar_idx", "day", "side", "anchor", "gap"))):
        if day != session:
            session, longs, shorts = day, 0, 0
        ok = bar != taken and not (key in last and bar - last[key] < gap) and (longs if side > 0 else shorts) < MOST_PER_SIDE
        fired.append(int(ok))
        if ok:
            last[key] = taken = bar
            longs, shorts = longs + (side > 0), shorts + (side < 0)
    now = p["bar_idx"].iloc[-1]
    keep = sorted((k, b) for k, b in last.items() if now - b < LONGEST_SPACING)
    return {"fired": fired, "priority": p["priority"]}, [session, longs, shorts, taken, *(x for kb in keep for x in kb)]


def admitted(d: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """(symbol, bar_idx, lane, setup_type, setup_family, setup fields): the fired setups of both lanes; exact over blocks.

    A candidate whose anchor was a candidate of its lane on the bar before is active already and cannot fire.
    """
    each = [F.when(c(f"cand_{n}").isNotNull(), F.struct(F.lit(lane).alias("lane"), F.lit(p).alias("priority"), F.lit(gap).alias("gap"), F.lit(n).alias("setup_type"), F.lit(fam).alias("setup_family"), c(f"cand_{n}").alias("x")))
            for n, fam, p, gap, lane in SETUPS]
    rows = d.select("symbol", "bar_idx", "session_date", F.array_compact(F.array(*each)).alias("cands"))
    rows = blocked(rows, lambda r, w: r.withColumn("before", F.transform(F.coalesce(w.lag("cands"), F.filter("cands", lambda x: F.lit(False))), lambda x: x["x"]["key"])), before=1)
    fresh = F.filter("cands", lambda x: ~F.array_contains("before", x["x"]["key"]))
    long = rows.select("symbol", "bar_idx", F.datediff("session_date", F.lit("1970-01-01").cast("date")).cast("double").alias("day"), F.explode(fresh).alias("s"))
    long = long.select("symbol", "bar_idx", "day", "s.*", c("s.x.side").alias("side"), F.shiftright(c("s.x.key"), 12).cast("double").alias("anchor"))  # 52 bits fit a double
    kept = chained(long.select("symbol", "lane", "bar_idx", "day", "priority", "gap", "side", "anchor"), _admission, [float("nan"), 0.0, 0.0, float("nan")], "fired int, priority int", ["day", "side", "anchor", "gap"],
                   size, keys=("symbol", "lane"), then=["priority"])
    return long.drop("side").join(kept.filter("fired = 1").drop("fired"), ["symbol", "lane", "bar_idx", "priority"]).select("symbol", "bar_idx", "lane", "setup_type", "setup_family", "x.*")

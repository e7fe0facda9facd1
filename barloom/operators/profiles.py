"""Profile anchors, their context columns and the six profile setups. All windows stay inside one session or one anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag, safe_div
from barloom.operators import futures as fu
from barloom.operators.blocks import carry_last
from barloom.operators.relate import asof, path

ZONE = "America/New_York"
COMPOSITE, HISTORY = 5, 20  #: sessions of the rolling composite; sessions of the value-area history
BLOCK = 96  #: bars screened at once for a first touch
LEVELS = ["poc", "vah", "val", "hvn", "lvn", "shape", "skew", "top_share", "bottom_share", "poc_share"]


def local_clock(date: Column, minutes: int) -> Column:
    """UTC instant of a New York wall-clock minute of a date."""
    return F.to_utc_timestamp(date.cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES"), ZONE)


def session_table(d: DataFrame, drive_minutes: int = 30, drive_bars: int = 6) -> DataFrame:
    """One row a symbol and session: place among sessions, RTH prices, initial balance, open drive. ``d``: session frame with atr_14."""
    rth = lambda x: F.when(c("is_rth"), x)
    early = F.when(c("is_rth") & (c("minutes_since_open") < drive_minutes), F.struct("ts", "low", "high", "close"))
    g = d.groupBy("symbol", "session_date").agg(
        F.min(rth(c("ts"))).alias("rth_open_ts"), F.min_by(rth(c("open")), rth(c("ts"))).alias("rth_open"), F.max_by(rth(c("close")), rth(c("ts"))).alias("rth_close"), F.max(rth(c("high"))).alias("rth_high"),
        F.min(rth(c("low"))).alias("rth_low"), F.max_by(rth(c("atr_14")), rth(c("ts"))).alias("rth_atr"), F.max(F.when(c("is_ib"), c("high"))).alias("ib_high"), F.min(F.when(c("is_ib"), c("low"))).alias("ib_low"),
        F.array_sort(F.collect_list(early)).alias("_e"))  # the bars of the drive window only
    close = F.transform("_e", lambda x: x["close"])
    step = F.zip_with(F.slice(close, 2, drive_bars * 100), close, lambda b, a: b - a)
    whole = F.filter(step, lambda x: x.isNotNull())
    last = F.element_at(close, -1)
    up = (F.array_min(F.transform("_e", lambda x: x["low"])) >= c("rth_open")) & (last > c("rth_open")) & F.forall(whole, lambda x: x >= 0)
    down = (F.array_max(F.transform("_e", lambda x: x["high"])) <= c("rth_open")) & (last < c("rth_open")) & F.forall(whole, lambda x: x <= 0)
    days = Window.partitionBy("symbol").orderBy("session_date")  # one row a trading day
    return g.withColumns({"open_drive": F.when(F.size("_e") >= drive_bars, flag(up | down)), "session_no": F.row_number().over(days), "rth_no": F.when(c("rth_open").isNotNull(), F.count("rth_open").over(days))}).drop("_e")


def anchor_bars(d: DataFrame, sessions: DataFrame, swings: DataFrame) -> DataFrame:
    """(symbol, anchor, key, ts, bar): bars of every anchor window. ``swings``: symbol, bar_idx (confirmation), prev_idx, swing_idx."""
    bar = ["symbol", "bar_idx", "ts", "open", "high", "low", "close", "volume"]
    day = c("session_date").cast("string")
    parts = [d.filter(on).select(*bar, F.lit(name).alias("anchor"), day.alias("key")) for name, on in (("prior_rth", c("is_rth")), ("overnight", c("is_overnight")), ("initial_balance", c("is_ib")))]
    numbered = d.filter("is_rth").join(sessions.select("symbol", "session_date", "rth_no"), ["symbol", "session_date"]).withColumn("_end", F.explode(F.sequence(c("rth_no"), c("rth_no") + COMPOSITE - 1)))
    ends = sessions.filter("rth_no IS NOT NULL").select("symbol", c("rth_no").alias("_end"), day.alias("key"))
    parts.append(numbered.join(ends, ["symbol", "_end"]).select(*bar, F.lit("composite").alias("anchor"), "key"))
    walk = path(swings.filter("prev_idx < swing_idx").select("symbol", c("bar_idx").alias("_at"), "prev_idx", "swing_idx"), d, c("prev_idx"), c("swing_idx"), ["ts", "open", "high", "low", "close", "volume"])
    parts.append(walk.select("symbol", c("path_idx").alias("bar_idx"), *[c(f"p_{x}").alias(x) for x in bar[2:]], F.lit("swing").alias("anchor"), c("_at").cast("string").alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def swing_windows(d: DataFrame) -> DataFrame:
    """(symbol, bar_idx, prev_idx, swing_idx): at each confirmation the stretch between the last two confirmed swings; none for two at one bar."""
    n = lambda kind: (c("bar_idx") * 2 + kind).alias("_o")
    ev = d.filter("confirmed_swing_high = 1").select("symbol", "bar_idx", n(0)).unionByName(d.filter("confirmed_swing_low = 1").select("symbol", "bar_idx", n(1)))
    ev = carry_last(ev.withColumn("swing_idx", c("bar_idx") - 3), {"prev_idx": c("swing_idx")}, order="_o", strict=True)
    last = ev.groupBy("symbol", "bar_idx").agg(F.max_by(F.struct("prev_idx", "swing_idx"), "_o").alias("w"))
    return last.select("symbol", "bar_idx", "w.*")


def day_types(sessions: DataFrame, levels: DataFrame) -> DataFrame:
    """Prior-day type of each RTH session: 1 normal, 2 normal variation, 3 trend, 4 double distribution, 5 neutral, 0 unknown. ``levels``: profiles of prior_rth."""
    s = sessions.join(levels, ["symbol", "session_date"])
    rng, ib = c("rth_high") - c("rth_low"), F.greatest(c("ib_high") - c("ib_low"), F.lit(1e-8))
    above, below = c("rth_high") > c("ib_high"), c("rth_low") < c("ib_low")
    pos = (c("rth_close") - c("rth_low")) / F.when(rng > 0, rng)
    out_up, out_down = c("rth_close") > c("vah"), c("rth_close") < c("val")
    one_up, one_down = (c("rth_close") > c("rth_open")) & (pos >= 0.75) & ~below, (c("rth_close") < c("rth_open")) & (pos <= 0.25) & ~above
    trend = rng >= 1.8 * ib
    kind = (F.when(~(rng > 0) | c("ib_high").isNull(), 0)
            .when(trend & (((c("shape") == "P") & one_up) | ((c("shape") == "b") & one_down)) & (out_up | out_down), 4).when(trend & ((out_up & one_up) | (out_down & one_down)), 3)
            .when(above & below, 5).when((rng >= 1.25 * ib) & (above | below), 2).otherwise(1))
    return s.withColumn("day_type", kind)


def history(s: DataFrame) -> DataFrame:
    """Value-area width against the ``HISTORY`` RTH sessions before: population z-score, median, and the last point of control and middle."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    back = w.rowsBetween(-HISTORY, -1)
    width = c("vah") - c("val")
    s = s.withColumns({"va_width": width, "_wa": width / F.when(c("rth_atr") != 0, c("rth_atr")), "va_mid": (c("vah") + c("val")) / 2.0})
    sd = F.stddev_pop("_wa").over(back)
    return s.withColumns({
        "width_z": F.when((F.count("_wa").over(back) >= 2) & (sd != 0), (c("_wa") - F.avg("_wa").over(back)) / F.when(sd != 0, sd)), "width_median": F.percentile("va_width", 0.5).over(back),
        "previous_poc": F.lag("poc").over(w), "previous_mid": F.lag("va_mid").over(w)}).drop("_wa")


def first_touch(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """``levels`` (symbol, price, born_idx) with dead_idx: first bar at or after birth that trades through the price. Ranges of ``BLOCK`` bars screen the candidates."""
    blk = F.floor(c("bar_idx") / BLOCK)
    ranges = bars.groupBy("symbol", blk.alias("_blk")).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    maybe = levels.join(ranges, "symbol").filter((c("_blk") >= F.floor(c("born_idx") / BLOCK)) & c("price").between(c("_lo"), c("_hi"))).select("symbol", "price", "born_idx", "_blk")
    hits = maybe.distinct().join(bars.select("symbol", blk.alias("_blk"), "bar_idx", "low", "high"), ["symbol", "_blk"]).filter((c("bar_idx") >= c("born_idx")) & c("price").between(c("low"), c("high")))
    return levels.join(hits.groupBy("symbol", "price", "born_idx").agg(F.min("bar_idx").alias("dead_idx")), ["symbol", "price", "born_idx"], "left")


def naked_context(d: DataFrame, levels: DataFrame) -> DataFrame:
    """Distances to levels that are still untouched at each bar's close; ``levels``: symbol, price, born_idx, dead_idx, anchor, session_no."""
    upto = F.coalesce(c("dead_idx"), c("_last"))
    last = d.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    alive = levels.join(last, "symbol").withColumn("_blk", F.explode(F.sequence(F.floor(c("born_idx") / BLOCK), F.floor(upto / BLOCK))))
    sets = alive.groupBy("symbol", "_blk").agg(F.array_sort(F.collect_list(F.struct("price", "born_idx", "dead_idx", "anchor", "session_no"))).alias("_set"))  # levels open in a stretch of bars
    out = d.withColumn("_blk", F.floor(c("bar_idx") / BLOCK)).join(sets, ["symbol", "_blk"], "left")
    now = F.filter(F.coalesce("_set", F.array()), lambda x: (x["born_idx"] <= c("bar_idx")) & (x["dead_idx"].isNull() | (x["dead_idx"] > c("bar_idx"))))
    out = out.withColumn("_now", now)
    nearest = lambda xs: F.array_min(F.transform(xs, lambda x: F.struct(F.abs(x["price"] - c("close")).alias("far"), x["born_idx"].alias("born"), x["price"].alias("price"), x["session_no"].alias("session_no"))))
    of = lambda a: nearest(F.filter("_now", lambda x: x["anchor"] == a))
    px = F.transform("_now", lambda x: x["price"])
    return out.withColumns({
        "naked_dist_above_atr": safe_div(F.array_min(F.filter(px, lambda p: p > c("close"))) - c("close"), "atr_14"), "naked_dist_below_atr": safe_div(c("close") - F.array_max(F.filter(px, lambda p: p < c("close"))), "atr_14"),
        "naked_count": F.when(c("atr_14") > 0, F.size(F.filter(px, lambda p: F.abs(p - c("close")) <= 3.0 * c("atr_14")))).otherwise(0), "naked_age_sessions": c("session_no") - nearest(c("_now"))["session_no"],
        "naked_session_dist_atr": safe_div(c("close") - of("prior_rth")["price"], "atr_14"), "naked_day_dist_atr": safe_div(c("close") - of("overnight")["price"], "atr_14")}).drop("_now", "_set", "_blk")


def anchored(d: DataFrame, sessions: DataFrame, levels: DataFrame, swings: DataFrame) -> DataFrame:
    """Bars with the latest complete profile of each anchor (``rth_``, ``on_``, ``ib_``, ``sw_``, ``cp_``) and of the session before (``sp_``)."""
    day = F.to_date("key")
    prof = F.struct(*LEVELS)
    one = lambda a, name, when: levels.filter(c("anchor") == a).select("symbol", day.alias("session_date"), when.alias("_at"), prof.alias(name))
    close16, open930 = local_clock(day, 960), local_clock(day, 570)
    past = one("prior_rth", "rth", close16).join(sessions.select("symbol", "session_date", "day_type", "width_z", "width_median", "previous_poc", "previous_mid", "va_width"), ["symbol", "session_date"])
    past = past.select("symbol", "_at", F.struct("rth.*", "session_date", "day_type", "width_z", "width_median", "previous_poc", "previous_mid", "va_width").alias("rth"))
    d = asof(d, past, "ts", "_at", ["rth"], strict=True)
    d = asof(d, one("overnight", "on", open930), "ts", "_at", ["on"], strict=True)
    d = asof(d, one("composite", "cp", close16), "ts", "_at", ["cp"], strict=True)
    ib = one("initial_balance", "ib", open930).drop("_at")
    d = d.join(ib, ["symbol", "session_date"], "left").withColumn("ib", F.when(c("is_rth") & c("ib_complete"), c("ib")))
    sw = swings.join(levels.filter("anchor = 'swing'").select("symbol", c("key").cast("long").alias("bar_idx"), prof.alias("_p")), ["symbol", "bar_idx"], "left").select("symbol", "bar_idx", F.struct(F.lit(1).alias("n"), "_p").alias("_sw"))
    d = carry_last(d.join(sw, ["symbol", "bar_idx"], "left"), {"_cur": c("_sw")}, strict=True).withColumn("sw", c("_cur._p")).drop("_sw", "_cur")
    w = Window.partitionBy("symbol").orderBy("session_date")  # RTH sessions, one row a day
    before = sessions.join(one("prior_rth", "_q", close16).drop("_at"), ["symbol", "session_date"])
    before = before.select("symbol", "session_date", F.lag(F.struct("_q.poc", "_q.vah", "_q.val", c("rth_close").alias("close"))).over(w).alias("sp"))
    return d.join(before, ["symbol", "session_date"], "left").join(sessions.select("symbol", "session_date", "session_no", "rth_open_ts", "rth_open", "open_drive", c("ib_high").alias("s_ib_high"), c("ib_low").alias("s_ib_low")), ["symbol", "session_date"], "left")


def context(d: DataFrame) -> DataFrame:
    """The context columns; ``d``: anchored bars with atr_14, gap and block distances and killzone flags."""
    px, a = c("close"), F.when(c("atr_14") != 0, c("atr_14"))
    r, o, s, q = (lambda x: c(f"rth.{x}")), (lambda x: c(f"on.{x}")), (lambda x: c(f"sw.{x}")), (lambda x: c(f"sp.{x}"))
    has = lambda x: c(f"{x}.poc").isNotNull()
    above = lambda xs: (F.array_min(F.filter(xs, lambda p: p > px)) - px) / a
    below = lambda xs: (px - F.array_max(F.filter(xs, lambda p: p < px))) / a
    near = lambda xs: F.array_min(F.transform(xs, lambda p: F.abs(p - px))) / a
    around = lambda xs: F.when(c("atr_14") > 0, F.size(F.filter(xs, lambda p: F.abs(p - px) <= c("atr_14")))).otherwise(0)
    rth = lambda x: F.when(has("rth"), x)
    both = has("rth") & has("on")
    span = F.greatest(r("vah"), o("vah")) - F.least(r("val"), o("val"))
    overlap = F.when(both, F.when(span > 0, F.greatest(F.least(r("vah"), o("vah")) - F.greatest(r("val"), o("val")), F.lit(0.0)) / F.when(span > 0, span)).otherwise(F.when((r("val") == o("val")) & (r("vah") == o("vah")), 1.0).otherwise(0.0)))
    three = both & has("sw")
    opened = q("poc").isNotNull() & (c("ts") >= c("rth_open_ts"))
    ib = c("ib.poc").isNotNull()
    up, down = c("high") > c("s_ib_high"), c("low") < c("s_ib_low")
    since = c("minutes_since_open")
    within = lambda x, n: F.coalesce(F.abs(x) <= n, F.lit(False))
    d = d.withColumns({
        "dist_poc_session_atr": rth((px - r("poc")) / a), "dist_vah_atr": rth((r("vah") - px) / a), "dist_val_atr": rth((px - r("val")) / a), "price_position_va": rth(F.when(r("vah") == r("val"), 0.5).otherwise((px - r("val")) / F.when(r("vah") != r("val"), r("vah") - r("val")))),
        "above_poc": rth(flag(px > r("poc"))), "in_va": rth(flag(px.between(r("val"), r("vah")))), "above_vah": rth(flag(px > r("vah"))), "below_val": rth(flag(px < r("val"))),
        "va_overshoot_atr": rth(F.when(px > r("vah"), (px - r("vah")) / a).when(px < r("val"), -(r("val") - px) / a).otherwise(0.0)), "profile_shape": rth(F.when(r("shape") == "P", 1).when(r("shape") == "b", -1).otherwise(0)),
        "vol_skew": r("skew"), "vol_top_share": r("top_share"), "vol_bottom_share": r("bottom_share"), "poc_vol_share": r("poc_share"), "hvn_count": rth(F.size(r("hvn"))), "lvn_count": rth(F.size(r("lvn"))),
        "hvn_count_1atr": rth(around(r("hvn"))), "lvn_count_1atr": rth(around(r("lvn"))), "hvn_above_close": above(r("hvn")), "hvn_below_close": below(r("hvn")), "dist_nearest_hvn_atr": near(r("hvn")), "dist_nearest_lvn_atr": near(r("lvn")),
        "dist_lvn_above_atr": above(r("lvn")), "dist_lvn_below_atr": below(r("lvn")), "va_width_atr": (r("vah") - r("val")) / a, "va_width_zscore_20": r("width_z"), "poc_migration_vel": (r("poc") - r("previous_poc")) / a,
        "va_migration_vel": ((r("vah") + r("val")) / 2.0 - r("previous_mid")) / a, "va_expansion": rth(flag(r("va_width") > r("width_median"))), "day_type": F.when(r("day_type") > 0, r("day_type")),
        "dist_poc_day_atr": (px - o("poc")) / a, "dist_poc_swing_atr": (px - s("poc")) / a, "poc_anchor_diff_atr": F.when(both, (r("poc") - o("poc")) / a), "va_overlap": overlap, "swing_poc_vs_session_poc": F.when(three, (s("poc") - r("poc")) / a),
        "multi_poc_cluster": F.when(three, flag((c("atr_14") > 0) & (F.greatest(r("poc"), o("poc"), s("poc")) - F.least(r("poc"), o("poc"), s("poc")) <= 0.5 * c("atr_14")))), "composite_poc_dist_atr": (px - c("cp.poc")) / a,
        "open_type": F.when(opened, F.when(c("rth_open").between(q("val"), q("vah")), 0).when(c("rth_open") > q("vah"), 1).otherwise(-1)), "open_vs_prior_poc_atr": F.when(opened, (c("rth_open") - q("poc")) / a),
        "open_gap_atr": F.when(opened, (c("rth_open") - q("close")) / a), "gap_into_value": F.when(opened, flag(c("rth_open").between(q("val"), q("vah")))),
        "session_phase": F.when(c("is_rth"), F.when(since < 30, 1).when(since < 120, 2).when(since < 240, 3).when(since < 330, 4).otherwise(5)), "open_drive_flag": F.when(c("is_rth"), c("open_drive")),
        "dist_ib_high_atr": F.when(ib, (c("s_ib_high") - px) / a), "dist_ib_low_atr": F.when(ib, (px - c("s_ib_low")) / a),
        "ib_extension": F.when(ib, F.when(up & down, F.when(px >= (c("s_ib_high") + c("s_ib_low")) / 2.0, 1).otherwise(-1)).when(up, 1).when(down, -1).otherwise(0))})
    return d.withColumns({
        "poc_plus_fvg": flag(within(c("dist_poc_session_atr"), 0.5) & (within(c("dist_to_bull_fvg_atr"), 0.5) | within(c("dist_to_bear_fvg_atr"), 0.5))),
        "vah_plus_ob": flag(within(c("dist_vah_atr"), 0.3) & within(c("dist_to_bear_order_block_atr"), 0.5)), "val_plus_ob": flag(within(c("dist_val_atr"), 0.3) & within(c("dist_to_bull_order_block_atr"), 0.5)),
        "in_killzone": flag((c("in_london_killzone") == 1) | (c("in_newyork_killzone") == 1))})


# Priority of each setup when confidences are equal.
PRIORITY = {4: 0, 2: 1, 3: 2, 5: 3, 1: 4, 6: 5}


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def setups(d: DataFrame) -> DataFrame:
    """``d`` with side and confidence of each setup (``s1_side``, ``s1_conf``, ...) and the selected one; state restarts with each session.

    A candidate is eligible unless the bar before it in the session had the same setup and side; the winner has the highest confidence, then priority.
    """
    w = Window.partitionBy("symbol", "session_date").orderBy("bar_idx")
    past, vz, yes = w.rowsBetween(Window.unboundedPreceding, -1), c("volume_zscore_50"), lambda x: F.coalesce(x, F.lit(False))
    a, vah, val = c("atr_14"), c("dist_vah_atr"), c("dist_val_atr")
    drive, is_drive = yes(c("open_drive_flag") == 1), F.when(yes(c("open_drive_flag") == 1), 1.0).otherwise(0.0)
    rng = F.when(c("high") > c("low"), c("high") - c("low"))
    disp = {1: yes(c("displacement_bullish") == 1), -1: yes(c("displacement_bearish") == 1)}
    real = {s: disp[s] & yes(vz >= 1.25) & yes(clamp(((c("close") - c("low")) if s > 0 else (c("high") - c("close"))) / rng) >= 0.75) for s in (1, -1)}
    over = {1: F.greatest(-vah, F.lit(0.0)), -1: F.greatest(-val, F.lit(0.0))}
    quiet = lambda n: F.when(vz.isNotNull(), clamp(1.0 - F.greatest(vz, F.lit(0.0)) / n)).otherwise(0.5)
    blank = lambda s, conf: F.struct(F.lit(s).cast("int").alias("side"), clamp(conf).alias("conf"))

    def fade(x, s):
        back = yes(x.between(-0.30, 0.65))
        broke = back & (x < 0) & real[-s] & yes(over[-s] >= 0.05)
        conf = 0.42 + 0.14 * clamp(1.0 - F.greatest(x, F.lit(0.0)) / 0.65) + 0.08 * F.when(x < 0, clamp(-x / 0.30)).otherwise(0.0) + 0.08 * quiet(1.25) + F.when(drive, 0.0).otherwise(0.06)
        return back, broke, blank(s, conf)
    hi, lo = fade(vah, -1), fade(val, 1)
    calm = (c("profile_shape") == 0) & (c("open_type") == 0)
    s1 = F.when(calm, F.when(hi[0], F.when(~hi[1], hi[2])).otherwise(F.when(lo[0] & ~lo[1], lo[2])))
    out_score = {s: blank(s, 0.58 + 0.18 * clamp((vz - 1.25) / 2.0) + 0.12 * clamp((over[s] - 0.05) / 0.35) + 0.05 * is_drive) for s in (1, -1)}
    s3 = F.when(vz >= 1.25, F.when(yes(c("above_vah") == 1), F.when(real[1] & yes(over[1] >= 0.05), out_score[1])).when(yes(c("below_val") == 1), F.when(real[-1] & yes(over[-1] >= 0.05), out_score[-1])))
    d = d.withColumn("_s3", s3)
    run = F.when(yes(c("above_vah") == 1), -1).when(yes(c("below_val") == 1), 1).otherwise(0)
    d = d.withColumns({"_run": run, "_up": F.last(F.when(c("_s3.side") == 1, c("bar_idx")), True).over(past), "_dn": F.last(F.when(c("_s3.side") == -1, c("bar_idx")), True).over(past)})
    d = d.withColumn("_isl", F.sum(flag(c("_run") != F.coalesce(F.lag("_run").over(w), F.lit(9)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_len", F.row_number().over(Window.partitionBy("symbol", "session_date", "_isl").orderBy("bar_idx")))
    d = d.withColumns({"_side": F.coalesce(F.lag("_run").over(w), F.lit(0)), "_n": F.coalesce(F.lag("_len").over(w), F.lit(0))})

    def retest(born, level, edge, s):
        age = c("bar_idx") - born
        touched = (edge <= level + 0.30 * a) if s > 0 else (edge >= level - 0.30 * a)
        held = (c("close") >= level - 0.05 * a) if s > 0 else (c("close") <= level + 0.05 * a)
        conf = 0.63 + 0.19 * clamp(1.0 - F.least(F.abs(c("close") - level), F.abs(edge - level)) / (0.35 * a)) + 0.12 * clamp(1.0 - (age - 1) / 14.0)
        return F.when(yes(age.between(1, 15) & (a > 0) & touched & held), blank(s, conf))
    s2 = F.coalesce(retest(c("_up"), c("close") + vah * a, c("low"), 1), retest(c("_dn"), c("close") - val * a, c("high"), -1))
    depth = F.when(c("_side") < 0, vah).otherwise(val)
    swept = F.when(c("_side") < 0, c("bars_since_sweep_high") <= 3).otherwise(c("bars_since_sweep_low") <= 3)
    s4 = F.when(yes(c("in_va") == 1) & (c("_side") != 0) & c("_n").between(1, 3) & ~drive & ~yes(vz > 0.75) & yes(swept) & yes(depth > 0.05),
                F.struct(c("_side").cast("int").alias("side"), clamp(0.66 + 0.10 * clamp(1.0 - (c("_n") - 1) / 2.0) + 0.10 * quiet(0.75) + 0.10 * clamp((depth - 0.05) / 0.25)).alias("conf")))
    lvn = c("dist_nearest_lvn_atr")
    near = 0.61 + 0.24 * clamp(1.0 - lvn / 0.3) + 0.05 * is_drive
    s5 = F.when(lvn <= 0.3, F.when(disp[1], blank(1, near)).when(disp[-1], blank(-1, near)))
    up, down = c("hvn_above_close"), c("hvn_below_close")
    least, most = F.least(up, down), F.greatest(up, down)
    balanced = calm & (c("in_va") == 1) & ~drive & ~disp[1] & ~disp[-1] & ~yes(vz > 0.50) & up.isNotNull() & down.isNotNull() & (least > 0.75) & (least < 2.5) & (most - least >= 0.30) & (most / F.greatest(least, F.lit(1e-8)) >= 1.35)
    s6 = F.when(balanced, F.struct(F.when(up < down, 1).otherwise(-1).cast("int").alias("side"), clamp(0.50 + 0.12 * clamp(least - 0.75) + 0.12 * clamp(most - least) + 0.08 * quiet(0.50)).alias("conf")))
    d = d.withColumns({"_s1": s1, "_s2": s2, "_s4": s4, "_s5": s5, "_s6": s6})
    ok = {k: c(f"_s{k}").isNotNull() & ~yes(F.lag(c(f"_s{k}.side")).over(w) == c(f"_s{k}.side")) for k in PRIORITY}
    pick = F.array_max(F.array_compact(F.array(*[F.when(ok[k], F.struct(c(f"_s{k}.conf").alias("conf"), F.lit(-p).alias("p"), F.lit(-k).alias("k"), c(f"_s{k}.side").alias("side"))) for k, p in PRIORITY.items()])))
    d = d.withColumn("_pick", pick).withColumns({f"s{k}_{x}": c(f"_s{k}.{x}") for k in PRIORITY for x in ("side", "conf")})
    d = d.withColumns({"setup_type": F.coalesce(-c("_pick.k"), F.lit(0)), "setup_side": F.coalesce(c("_pick.side"), F.lit(0)), "setup_confidence": F.coalesce(c("_pick.conf"), F.lit(0.0))})
    swept_now = yes(c("bars_since_sweep_high") <= 3) | yes(c("bars_since_sweep_low") <= 3)
    return d.withColumn("failed_auction_with_sweep", flag((c("setup_type") == 4) & swept_now)).drop(*[x for x in d.columns if x.startswith("_")])

"""Bar feature families. Those with a bounded look-back take block rows plus a :class:`Frame` and compose inside one partitioning (``LOOK`` rows cover
the longest). Event ages, latest levels and impulse islands reach back without bound; they are block scans over the whole history
(:func:`carry_last`, :func:`running`), so no result depends on where a block ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.functions.cols import (c, clip, depth_quality, flag, mean_of, pct, proximity, safe_div, sign3, true_range)
from barloom.operators.blocks import BLOCK_ROWS, Frame, blocked, carry_last, running, with_kernel
from barloom.operators.recursive import SMOOTH, smooth
from barloom.store import saved

LOOK = 160


def ages(d: DataFrame, events: dict[str, Column], size: int = BLOCK_ROWS) -> DataFrame:
    """Bars since each condition last held, over the whole history; null before its first time."""
    d = carry_last(d, {f"_at_{n}": F.when(cond, c("bar_idx")) for n, cond in events.items()}, size=size)
    return d.withColumns({n: c("bar_idx") - c(f"_at_{n}") for n in events}).drop(*[f"_at_{n}" for n in events])


def price_action(d: DataFrame, w: Frame) -> DataFrame:
    rng, body = c("high") - c("low"), c("close") - c("open")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    prev = w.lag("close")
    ratio = safe_div("close", prev)
    d = d.withColumns({
        "close_return_1": pct(w, "close", 1), "close_return_3": pct(w, "close", 3), "close_return_5": pct(w, "close", 5),
        "close_return_10": pct(w, "close", 10), "log_return_1": F.when(ratio > 0, F.log(ratio)),
        "candle_body": body, "candle_body_pct": safe_div(body, "open"), "candle_range": rng, "upper_wick": c("high") - top,
        "lower_wick": bottom - c("low"), "body_to_range": safe_div(F.abs(body), rng),
        "close_location": safe_div(c("close") - c("low"), rng, 0.5), "gap_return_1": safe_div(c("open") - prev, prev),
        "bullish_candle": flag(c("close") > c("open")), "bearish_candle": flag(c("close") < c("open")),
    })
    return d.withColumns({"range_expansion_1": safe_div("candle_range", w.lag("candle_range")), "doji_like": flag(c("body_to_range") < 0.1)})


def volatility(d: DataFrame, w: Frame) -> DataFrame:
    d = d.withColumns({"true_range": true_range(w), "_ret": pct(w, "close"), "_rng": c("high") - c("low")})
    d = d.withColumns({
        "atr_14": w.mean("true_range", 14), "atr_50": w.mean("true_range", 50), "rolling_vol_20": w.std("_ret", 20),
        "rolling_vol_60": w.std("_ret", 60), "_m20": w.mean("close", 20), "_s20": w.std("close", 20),
        "_span20": w.max("high", 20) - w.min("low", 20), "_r20": w.mean("_rng", 20)})
    return d.withColumns({
        "atr_ratio_14_50": safe_div("atr_14", "atr_50"), "range_atr_14": safe_div("_rng", "atr_14"),
        "volatility_expansion_20": safe_div("rolling_vol_20", "rolling_vol_60"), "bb_width_20": safe_div(c("_s20") * 4.0, "_m20"),
        "donchian_width_20": safe_div("_span20", "atr_14"), "range_shock_20": safe_div("_rng", "_r20"),
    }).drop("_ret", "_rng", "_m20", "_s20", "_span20", "_r20")


def trend(d: DataFrame, w: Frame) -> DataFrame:
    """Needs the smooth kernel's columns and atr_14."""
    d = d.withColumns({"sma_20": w.mean("close", 20), "sma_50": w.mean("close", 50)})
    a = "atr_14"
    return d.withColumns({
        "close_vs_ema_8_atr": safe_div(c("close") - c("ema_8"), a), "close_vs_ema_21_atr": safe_div(c("close") - c("ema_21"), a),
        "close_vs_ema_50_atr": safe_div(c("close") - c("ema_50"), a), "close_vs_sma_20_atr": safe_div(c("close") - c("sma_20"), a),
        "ema_spread_8_21_atr": safe_div(c("ema_8") - c("ema_21"), a), "ema_spread_21_50_atr": safe_div(c("ema_21") - c("ema_50"), a),
        "ema_slope_8_3": safe_div(c("ema_8") - w.lag("ema_8", 3), a), "ema_slope_21_5": safe_div(c("ema_21") - w.lag("ema_21", 5), a),
        "ema_alignment": sign3((c("ema_8") > c("ema_21")) & (c("ema_21") > c("ema_50")), (c("ema_8") < c("ema_21")) & (c("ema_21") < c("ema_50"))),
        "macd_hist": c("macd_line") - c("macd_signal"),
    })


def momentum(d: DataFrame, w: Frame) -> DataFrame:
    d = d.withColumns({
        "rsi_from_mid": c("rsi_14") - 50, "rsi_delta_3": c("rsi_14") - w.lag("rsi_14", 3), "roc_5": pct(w, "close", 5), "roc_10": pct(w, "close", 10),
        "momentum_atr_5": safe_div(c("close") - w.lag("close", 5), "atr_14"), "_lo": w.min("close", 14), "_hi": w.max("close", 14)})
    d = d.withColumns({"stoch_position_14": safe_div(c("close") - c("_lo"), c("_hi") - c("_lo"), 0.5),
                       "price_acceleration_3": c("roc_5") - w.lag("roc_5", 3)})
    return d.withColumn("exhaustion_score", F.abs("close_vs_ema_8_atr") * F.abs("rsi_from_mid")
                        * -F.coalesce("price_acceleration_3", F.lit(0.0))).drop("_lo", "_hi")


def volume(d: DataFrame, w: Frame) -> DataFrame:
    change = F.coalesce(c("close") - w.lag("close"), F.lit(0.0))
    d = d.withColumns({"_up": F.when(change > 0, c("volume")).otherwise(0.0), "_dn": F.when(change < 0, c("volume")).otherwise(0.0),
                       "log_volume": F.log1p(clip("volume", 0.0)), "_mf": (c("close") - c("open")) * c("volume")})
    d = d.withColumns({
        "_v20": w.mean("volume", 20), "_t10": w.sum("volume", 10), "_u10": w.sum("_up", 10), "_d10": w.sum("_dn", 10),
        "money_flow_10": w.sum("_mf", 10), "_lm": w.mean("log_volume", 50), "_ls": w.std("log_volume", 50)})
    d = d.withColumns({
        "volume_relative_20": safe_div("volume", "_v20"), "volume_zscore_50": safe_div(c("log_volume") - c("_lm"), "_ls"),
        "up_volume_share_10": safe_div("_u10", "_t10", 0.5), "down_volume_share_10": safe_div("_d10", "_t10", 0.5),
        "dollar_volume": c("close") * c("volume")})
    return d.withColumn("volume_imbalance_10", c("up_volume_share_10") - c("down_volume_share_10")).drop(
        "_up", "_dn", "_mf", "_v20", "_t10", "_u10", "_d10", "_lm", "_ls")


def structure(d: DataFrame, w: Frame) -> DataFrame:
    d = d.withColumns({"prior_high_20": w.max("high", 20, 1), "prior_low_20": w.min("low", 20, 1),
                       "prior_high_50": w.max("high", 50, 1), "prior_low_50": w.min("low", 50, 1)})
    a, rng = "atr_14", c("high") - c("low")
    body, ratr = safe_div(F.abs(c("close") - c("open")), rng), safe_div(rng, a)
    strong = (body > 0.65) & (ratr > 1.5)
    d = d.withColumns({
        "dist_to_prior_high_20_atr": safe_div(c("prior_high_20") - c("close"), a), "dist_to_prior_low_20_atr": safe_div(c("close") - c("prior_low_20"), a),
        "dist_to_prior_high_50_atr": safe_div(c("prior_high_50") - c("close"), a), "dist_to_prior_low_50_atr": safe_div(c("close") - c("prior_low_50"), a),
        "price_position_50": safe_div(c("close") - c("prior_low_50"), c("prior_high_50") - c("prior_low_50"), 0.5),
        "breakout_high_20": flag(c("high") > c("prior_high_20")), "breakout_low_20": flag(c("low") < c("prior_low_20")),
        "sweep_high_20": flag((c("high") > c("prior_high_20")) & (c("close") < c("prior_high_20"))),
        "sweep_low_20": flag((c("low") < c("prior_low_20")) & (c("close") > c("prior_low_20"))),
        "displacement_bullish": flag((c("close") > c("open")) & strong), "displacement_bearish": flag((c("close") < c("open")) & strong)})
    return d.withColumns({
        "in_discount_zone": flag(c("price_position_50") < 0.35), "in_premium_zone": flag(c("price_position_50") > 0.65),
        "structure_pressure": c("breakout_high_20") - c("breakout_low_20")})


def structure_ages(d: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    return ages(d, {"bars_since_sweep_high": c("sweep_high_20") == 1, "bars_since_sweep_low": c("sweep_low_20") == 1}, size)


def session(d: DataFrame, w: Frame | None = None) -> DataFrame:
    t = clock.local("ts")
    d = d.withColumns({"hour": F.hour(t), "minute": F.minute(t), "day_of_week": F.weekday(t), "month": F.month(t), **clock.sessions()})
    two_pi = 6.283185307179586
    return d.withColumns({"hour_sin": F.sin(two_pi * c("hour") / 24.0), "hour_cos": F.cos(two_pi * c("hour") / 24.0),
                          "dow_sin": F.sin(two_pi * c("day_of_week") / 7.0), "dow_cos": F.cos(two_pi * c("day_of_week") / 7.0)})


def microstructure(d: DataFrame, w: Frame, tick: float | None = None) -> DataFrame:
    rng, body = c("high") - c("low"), c("close") - c("open")
    vol = F.when(c("volume") != 0, c("volume"))
    spread = rng if tick is None else clip(rng, tick, 2.0 * tick)
    return d.withColumns({
        "approx_spread": spread, "relative_spread_bps": safe_div(spread, "close") * 10000.0, "price_impact_proxy": body / vol,
        "amihud_proxy": F.abs(pct(w, "close")) / vol, "kyle_lambda_proxy": F.abs(body) / vol,
        "order_flow_toxicity": F.coalesce(c("close") - w.lag("close"), F.lit(0.0)) * F.coalesce("volume", F.lit(0.0)),
        "intrabar_efficiency": safe_div(F.abs(body), rng), "range_to_volume": rng / vol,
        "close_location_micro": safe_div(c("close") - c("low"), rng, 0.5)})


def quality(d: DataFrame, w: Frame) -> DataFrame:
    rng = c("high") - c("low")
    return d.withColumns({
        "anomaly_range_gt_10atr": flag(rng > c("atr_14") * 10), "close_outside_bar_flag": flag((c("close") > c("high")) | (c("close") < c("low"))),
        "open_outside_bar_flag": flag((c("open") > c("high")) | (c("open") < c("low"))), "range_vs_atr": safe_div(rng, "atr_14"),
        "zero_volume_flag": flag(F.coalesce("volume", F.lit(0.0)) <= 0),
        "large_time_gap_flag": flag(F.unix_timestamp("ts") - F.unix_timestamp(w.lag("ts")) > 3600)})


def frac_weights(d: float = 0.4, threshold: float = 1e-3, max_size: int = 200) -> list[float]:
    """Binomial expansion weights of (1-B)^d, newest first, cut at the threshold."""
    out = [1.0]
    while len(out) < max_size:
        k = len(out)
        nxt = out[-1] * (k - 1 - d) / k
        if abs(nxt) < threshold:
            break
        out.append(nxt)
    return out


def fractional_diff(d: DataFrame, w: Frame, order: float = 0.4, threshold: float = 1e-3, max_size: int = 200) -> DataFrame:
    wt = frac_weights(order, threshold, max_size)
    n = len(wt)
    window = F.collect_list("close").over(w.rows(-(n - 1), 0))
    oldest_first = F.array(*[F.lit(x) for x in reversed(wt)])
    total = F.aggregate(F.zip_with(window, oldest_first, lambda x, k: x * k), F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("fracdiff_close", F.when(F.size(window) == n, total))
    return d.withColumn("fracdiff_close_return_1", c("fracdiff_close") - w.lag("fracdiff_close"))


def swings(d: DataFrame, w: Frame, n: int = 3) -> DataFrame:
    """Raw pivots (look-ahead) and their confirmed forms published n bars later."""
    left_hi, left_lo = w.max("high", n, 1), w.min("low", n, 1)
    right = w.rows(1, n)
    right_hi = F.when(F.count("high").over(right) == n, F.max("high").over(right))
    right_lo = F.when(F.count("low").over(right) == n, F.min("low").over(right))
    d = d.withColumns({"raw_swing_high": flag((c("high") > left_hi) & (c("high") > right_hi)),
                       "raw_swing_low": flag((c("low") < left_lo) & (c("low") < right_lo))})
    d = d.withColumns({
        "confirmed_swing_high": F.coalesce(w.lag("raw_swing_high", n), F.lit(0)), "confirmed_swing_low": F.coalesce(w.lag("raw_swing_low", n), F.lit(0)),
        "_hl": F.when(w.lag("raw_swing_high", n) == 1, w.lag("high", n)), "_ll": F.when(w.lag("raw_swing_low", n) == 1, w.lag("low", n))})
    return d.withColumns({"swing_high_level": c("_hl"), "swing_low_level": c("_ll")}).drop("_hl", "_ll")


def latest_levels(d: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Last confirmed swing levels and the ages of sweeps, in one scan."""
    d = carry_last(d, {"latest_swing_high": c("swing_high_level"), "latest_swing_low": c("swing_low_level"), "_hi": F.when(c("sweep_high_20") == 1, c("bar_idx")),
                       "_lo": F.when(c("sweep_low_20") == 1, c("bar_idx"))}, size=size)
    return d.withColumns({"bars_since_sweep_high": c("bar_idx") - c("_hi"), "bars_since_sweep_low": c("bar_idx") - c("_lo")}).drop("_hi", "_lo")


def pivots(d: DataFrame, w: Frame, n: int = 3) -> DataFrame:
    """Oscillator at the swings that a bar confirms."""
    return d.withColumns({"_hr": F.when(w.lag("raw_swing_high", n) == 1, w.lag("rsi_14", n)), "_lr": F.when(w.lag("raw_swing_low", n) == 1, w.lag("rsi_14", n))})


def exhaustion(d: DataFrame, size: int = BLOCK_ROWS, n: int = 3) -> DataFrame:
    """Needs rsi_14, atr_14, volume_relative_20, the prior extremes and confirmed swings; adds their latest levels where they are absent.

    All last known values come from one scan of the history; those that count the bar itself are its own value, else the one carried to it.
    """
    hi_ok, lo_ok = c("swing_high_level").isNotNull() & c("_hr").isNotNull(), c("swing_low_level").isNotNull() & c("_lr").isNotNull()
    if "_hr" not in d.columns:
        d = saved(blocked(d, lambda r, w: pivots(r, w, n), before=n, size=size), "pivots")
    far = {"_php": F.when(hi_ok, c("swing_high_level")), "_phr": F.when(hi_ok, c("_hr")), "_plp": F.when(lo_ok, c("swing_low_level")), "_plr": F.when(lo_ok, c("_lr")), "_atr": c("atr_14")}
    now = {"_atr": F.coalesce(c("atr_14"), c("_atr"))}
    if "latest_swing_high" not in d.columns:
        hi, lo = F.when(c("sweep_high_20") == 1, c("bar_idx")), F.when(c("sweep_low_20") == 1, c("bar_idx"))
        far |= {"_sh": c("swing_high_level"), "_sl": c("swing_low_level"), "_hi": hi, "_lo": lo}
        now |= {"latest_swing_high": F.coalesce(c("swing_high_level"), c("_sh")), "latest_swing_low": F.coalesce(c("swing_low_level"), c("_sl")),
                "bars_since_sweep_high": c("bar_idx") - F.coalesce(hi, c("_hi")), "bars_since_sweep_low": c("bar_idx") - F.coalesce(lo, c("_lo"))}
    d = carry_last(d, far, size=size, strict=True).withColumns(now)
    d = saved(blocked(d, _exhaustion, before=61, size=size), "exhaustion")
    return ages(d, {"bars_since_bullish_divergence": c("bullish_divergence_event") == 1, "bars_since_bearish_divergence": c("bearish_divergence_event") == 1}, size)


def _exhaustion(d: DataFrame, w: Frame) -> DataFrame:
    hi_ok, lo_ok = c("swing_high_level").isNotNull() & c("_hr").isNotNull(), c("swing_low_level").isNotNull() & c("_lr").isNotNull()
    d = d.withColumns({
        "_r": pct(w, "close"), "_rng": c("high") - c("low"), "_atr": F.coalesce("_atr", F.lit(0.0))})
    d = d.withColumns({
        "return_slope_3": w.mean("_r", 3), "return_slope_8": w.mean("_r", 8), "_s21": w.mean("_r", 21),
        "rsi_slope_3": (c("rsi_14") - w.lag("rsi_14", 3)) / 3.0, "rsi_slope_8": (c("rsi_14") - w.lag("rsi_14", 8)) / 8.0,
        "_q21": (c("rsi_14") - w.lag("rsi_14", 21)) / 21.0, "_g10": w.mean("_rng", 10), "_g50": w.mean("_rng", 50),
        "_v10": w.std("_r", 10), "_v50": w.std("_r", 50), "_w3": w.mean("volume_relative_20", 3), "_w10": w.mean("volume_relative_20", 10),
        "_bh": flag(c("high") > c("prior_high_20")), "_bl": flag(c("low") < c("prior_low_20"))})
    scale = F.when(c("_atr") > 0, c("_atr")).otherwise(1.0)
    bear = hi_ok & (c("swing_high_level") > c("_php")) & (c("_hr") < c("_phr"))
    bull = lo_ok & (c("swing_low_level") < c("_plp")) & (c("_lr") > c("_plr"))
    d = d.withColumns({
        "return_slope_decay_3_8": c("return_slope_3") - c("return_slope_8"), "return_slope_decay_8_21": c("return_slope_8") - c("_s21"),
        "rsi_slope_decay_3_8": c("rsi_slope_3") - c("rsi_slope_8"), "rsi_slope_decay_8_21": c("rsi_slope_8") - c("_q21"),
        "distance_from_bull_origin_atr": safe_div(c("close") - c("latest_swing_low"), "atr_14"),
        "distance_from_bear_origin_atr": safe_div(c("latest_swing_high") - c("close"), "atr_14"),
        "bullish_divergence_event": flag(bull), "bearish_divergence_event": flag(bear),
        "bullish_divergence_strength": F.when(bull, (c("_plp") - c("swing_low_level")) / scale * ((c("_lr") - c("_plr")) / 50.0)).otherwise(0.0),
        "bearish_divergence_strength": F.when(bear, (c("swing_high_level") - c("_php")) / scale * ((c("_phr") - c("_hr")) / 50.0)).otherwise(0.0),
        "range_compression_10_50": safe_div("_g10", "_g50"), "volatility_compression_10_50": safe_div("_v10", "_v50"),
        "range_expansion_shock_10": safe_div("_rng", "_g10")})
    fade = clip(c("_w10") - c("_w3"), 0.0)
    d = d.withColumns({
        "compression_regime": flag((c("range_compression_10_50") < 0.8) & (c("volatility_compression_10_50") < 0.8)),
        "bull_volume_exhaustion": clip("distance_from_bull_origin_atr", 0.0) * fade * (clip(c("rsi_14") - 50, 0.0) / 50.0),
        "bear_volume_exhaustion": clip("distance_from_bear_origin_atr", 0.0) * fade * (clip(50 - c("rsi_14"), 0.0) / 50.0),
        "failed_breakout_bull": flag((c("_bh") == 1) & (c("close") < c("prior_high_20"))),
        "failed_breakout_bear": flag((c("_bl") == 1) & (c("close") > c("prior_low_20"))),
        "failed_continuation_bull": flag((w.lag("_bh") == 1) & (c("close") < c("prior_high_20"))),
        "failed_continuation_bear": flag((w.lag("_bl") == 1) & (c("close") > c("prior_low_20")))})
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def temporal(d: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Event ages, densities and sweep-displacement order. Structure breaks come from bos_*/choch_* columns when present."""
    body = F.abs(c("close") - c("open"))
    d = d.withColumns({"bullish_rejection": flag((c("lower_wick") > body * 1.5) & (c("close_location") > 0.6)),
                       "bearish_rejection": flag((c("upper_wick") > body * 1.5) & (c("close_location") < 0.4))})
    has = lambda n: (c(n) == 1) if n in d.columns else F.lit(False)
    sweep = has("sweep_high_20") | has("sweep_low_20")
    disp = has("displacement_bullish") | has("displacement_bearish")
    bos, choch = has("bos_bull") | has("bos_bear"), has("choch_bull") | has("choch_bear")
    rej = has("bullish_rejection") | has("bearish_rejection")
    swing = has("confirmed_swing_high") | has("confirmed_swing_low")
    major = sweep | bos | choch | disp | rej
    at = lambda cond: F.when(cond, c("bar_idx"))
    since = {"bars_since_last_sweep": sweep, "bars_since_last_bos": bos, "bars_since_last_choch": choch, "bars_since_last_displacement": disp,
             "bars_since_last_rejection": rej, "cooldown_since_major_event": major}
    last = {"_lsl": has("sweep_low_20"), "_lsh": has("sweep_high_20"), "_ldb": has("displacement_bullish"), "_lds": has("displacement_bearish"),
            "_sb": has("bos_bull") | has("choch_bull"), "_ss": has("bos_bear") | has("choch_bear")}
    d = saved(d.withColumns({"_m": flag(major), "_sw": flag(swing)}), "events")
    d = carry_last(d, {**{f"_at_{n}": at(cond) for n, cond in since.items()}, **{n: at(cond) for n, cond in last.items()}}, size=size)
    d = d.withColumns({**{n: c("bar_idx") - c(f"_at_{n}") for n in since}, **{n: F.coalesce(n, F.lit(-1)) for n in last}}).drop(*[f"_at_{n}" for n in since])
    return blocked(d, _temporal, before=50, size=size)


def _temporal(d: DataFrame, w: Frame) -> DataFrame:
    near = F.abs("close_vs_ema_8_atr") <= 1.0
    order = lambda s, t: (c(s) >= 0) & (c(t) > c(s)) & (c("bar_idx") - c(t) <= 10) & (c(t) - c(s) <= 8)
    bull, bear = order("_lsl", "_ldb"), order("_lsh", "_lds")
    w10, w25, w20, w50 = w.rows(-9, 0), w.rows(-24, 0), w.rows(-19, 0), w.rows(-49, 0)
    d = d.withColumns({
        "major_event_density_10": F.avg("_m").over(w10), "major_event_density_25": F.avg("_m").over(w25),
        "major_event_cluster_10": F.sum("_m").over(w10), "major_event_cluster_25": F.sum("_m").over(w25),
        "swing_density_20": F.avg("_sw").over(w20), "swing_density_50": F.avg("_sw").over(w50),
        "bull_sequence_sweep_displacement": flag(bull), "bear_sequence_sweep_displacement": flag(bear),
        "bull_sequence_sweep_displacement_retrace": flag(bull & near & (c("_sb") >= c("_ldb"))),
        "bear_sequence_sweep_displacement_retrace": flag(bear & near & (c("_ss") >= c("_lds"))),
        "in_london_early": c("in_london_killzone"),
        "in_london_mid": flag((c("in_london_session") == 1) & (c("in_london_killzone") == 0) & (c("hour") < 8)),
        "in_london_late": flag((c("in_london_session") == 1) & (c("in_london_killzone") == 0) & (c("hour") >= 8)),
        "in_newyork_early": c("in_newyork_killzone"), "in_newyork_mid": flag((c("hour") >= 11) & (c("in_newyork_session") == 1) & (c("hour") < 14)),
        "in_newyork_late": flag((c("hour") >= 14) & (c("in_newyork_session") == 1))})
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def pullback(d: DataFrame, size: int = BLOCK_ROWS, n: int = 3) -> DataFrame:
    """Impulse, peak and retracement geometry per side. Each impulse opens an island; the peak is the running extreme inside it."""
    d = blocked(d, lambda r, w: _impulses(r, w, n), before=4 * n, size=size)
    sides = (("b", "continuation_bull_impulse_event", "high", 1, "latest_swing_low", "_flo", "prior_high_20"),
             ("s", "continuation_bear_impulse_event", "low", -1, "latest_swing_high", "_fhi", "prior_low_20"))
    new = {}
    for side, ev, _, _, origin, fall, level in sides:
        on = c(ev) == 1
        new |= {f"_{side}at": F.when(on, c("bar_idx")), f"_{side}or": F.when(on, F.coalesce(origin, fall)), f"_{side}lv": F.when(on, F.coalesce(level, "close"))}
    d = saved(carry_last(saved(d, "impulses"), new, size=size), "islands")
    for side, _, ext, sign, *_ in sides:  # narrow tables: one island key at a time
        isl, pk, pi = ("symbol", f"_{side}at"), f"_{side}pk", f"_{side}pi"
        n = saved(running(d.select(*isl, "bar_idx", ext), maxs={pk: c(ext) * sign}, keys=isl, size=size), "peaks")
        n = n.withColumn(pk, F.when(c(isl[1]).isNotNull(), c(pk) * sign))
        n = carry_last(n, {pi: F.when(c(ext) == c(pk), c("bar_idx"))}, keys=isl, size=size)
        d = d.join(n.select("symbol", "bar_idx", pk, pi), ["symbol", "bar_idx"])
    d = saved(blocked(d, _pullback, before=16, size=size), "pullback")
    return ages(d, {"continuation_bars_since_bull_resume": c("continuation_bull_resume_event") == 1,
                    "continuation_bars_since_bear_resume": c("continuation_bear_resume_event") == 1}, size)


def _impulses(d: DataFrame, w: Frame, n: int) -> DataFrame:
    d = d.withColumns({"_bt": flag(c("ema_alignment") > 0), "_st": flag(c("ema_alignment") < 0), "_atr": F.when(c("atr_14") != 0, c("atr_14")),
                       "_flo": F.min("low").over(w.rows(-2 * n, 0)), "_fhi": F.max("high").over(w.rows(-2 * n, 0)),
                       "_sm": F.avg("close").over(w.rows(-2, 0))})
    disp_up, disp_dn = c("displacement_bullish") == 1, c("displacement_bearish") == 1
    brk_up, brk_dn = c("breakout_high_20") == 1, c("breakout_low_20") == 1
    d = d.withColumns({
        "_bi": flag((c("_bt") == 1) & (disp_up | brk_up) & (c("close") > c("open")) & (c("close_location") > 0.55)),
        "_si": flag((c("_st") == 1) & (disp_dn | brk_dn) & (c("close") < c("open")) & (c("close_location") < 0.45)),
        "_slope": safe_div(c("_sm") - w.lag("_sm", 8), c("_atr") * 8.0)})
    return d.withColumns({"continuation_bull_impulse_event": flag((c("_bi") == 1) & (F.coalesce(w.lag("_bi"), F.lit(0)) == 0)),
                          "continuation_bear_impulse_event": flag((c("_si") == 1) & (F.coalesce(w.lag("_si"), F.lit(0)) == 0))})


def _pullback(d: DataFrame, w: Frame) -> DataFrame:
    rng = c("high") - c("low")
    disp_up, disp_dn = c("displacement_bullish") == 1, c("displacement_bearish") == 1
    brk_up, brk_dn = c("breakout_high_20") == 1, c("breakout_low_20") == 1
    ok = c("_atr") > 0
    bull, bear = ok & c("_bat").isNotNull(), ok & c("_sat").isNotNull()
    d = d.withColumns({
        "continuation_bars_since_bull_impulse": F.when(bull, c("bar_idx") - c("_bat")), "continuation_bars_since_bear_impulse": F.when(bear, c("bar_idx") - c("_sat")),
        "_bpb": F.when(bull, c("bar_idx") - c("_bpi")), "_spb": F.when(bear, c("bar_idx") - c("_spi")),
        "continuation_bull_impulse_magnitude_atr": F.when(bull, F.greatest(c("_bpk") - c("_bor"), F.lit(0.0)) / c("_atr")),
        "continuation_bear_impulse_magnitude_atr": F.when(bear, F.greatest(c("_sor") - c("_spk"), F.lit(0.0)) / c("_atr")),
        "continuation_bull_pullback_depth_atr": F.when(bull, F.greatest(c("_bpk") - c("low"), F.lit(0.0)) / c("_atr")),
        "continuation_bear_pullback_depth_atr": F.when(bear, F.greatest(c("high") - c("_spk"), F.lit(0.0)) / c("_atr"))})
    for s in ("bull", "bear"):
        mag, dep = c(f"continuation_{s}_impulse_magnitude_atr"), c(f"continuation_{s}_pullback_depth_atr")
        d = d.withColumn(f"continuation_{s}_pullback_depth_ratio", F.when(mag > 1e-9, dep / mag))
        tr, pb = ("_bt", "_bpb") if s == "bull" else ("_st", "_spb")
        d = d.withColumn(f"continuation_{s}_pullback_active", flag(
            (c(tr) == 1) & c(pb).between(1, 48) & (mag >= 0.25) & (dep >= 0.10) & (c(f"continuation_{s}_pullback_depth_ratio") <= 1.25)))
        floor_ = c("close_vs_ema_21_atr") if s == "bull" else -c("close_vs_ema_21_atr")
        lv, act = c("_blv" if s == "bull" else "_slv"), c(f"continuation_{s}_pullback_active") == 1
        score = (proximity(F.abs("close_vs_ema_21_atr"), 1.25) + proximity(F.abs(c("close") - lv) / c("_atr"), 1.5)
                 + F.coalesce(clip((floor_ + 0.75) / 1.5, 0.0, 1.0), F.lit(0.0)) + depth_quality(f"continuation_{s}_pullback_depth_ratio")) / 4.0
        slope = clip(-c("_slope") if s == "bull" else c("_slope"), 0.0)
        wick = clip(safe_div("lower_wick" if s == "bull" else "upper_wick", rng, 0.0), 0.0)
        loc = c("close_location") if s == "bull" else 1.0 - c("close_location")
        body = clip(safe_div(F.abs(c("close") - c("open")), rng, 0.0), 0.0, 1.0)
        d = d.withColumns({
            f"continuation_{s}_retest_quality": F.when(act, score).otherwise(0.0),
            f"continuation_{s}_pullback_channel_slope_8_atr": F.when(act, slope).otherwise(0.0),
            f"continuation_{s}_wick_rejection_score": wick * loc * (1.0 - body) * c(f"continuation_{s}_pullback_active"),
            f"_{s}rec": F.max(f"continuation_{s}_pullback_active").over(w.rows(-8, -1))})
    d = d.withColumns({"_rh3": w.max("high", 3, 1), "_rl3": w.min("low", 3, 1)})
    d = d.withColumns({
        "continuation_bull_resume_event": flag((c("_bt") == 1) & (c("_bullrec") == 1) & (c("close") > c("open")) & (c("close_location") > 0.55)
                                               & (F.coalesce(c("close") > c("_rh3"), F.lit(False)) | disp_up | brk_up)),
        "continuation_bear_resume_event": flag((c("_st") == 1) & (c("_bearrec") == 1) & (c("close") < c("open")) & (c("close_location") < 0.45)
                                               & (F.coalesce(c("close") < c("_rl3"), F.lit(False)) | disp_dn | brk_dn))})
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def interactions(d: DataFrame, w: Frame | None = None) -> DataFrame:
    """Products of columns already present; absent higher-timeframe columns leave their terms out."""
    has = set(d.columns)
    htf = c("htf_alignment_score") if "htf_alignment_score" in has else None
    prox = lambda names: [proximity(n) for n in names if n in has]
    lows = prox(["latest_low_dist_atr", "htf_4h_dist_to_swing_low_atr", "htf_1d_dist_to_swing_low_atr", "htf_dist_to_prev_day_low_atr",
                 "htf_dist_to_rolling_daily_low_atr"])
    highs = prox(["latest_high_dist_atr", "htf_4h_dist_to_swing_high_atr", "htf_1d_dist_to_swing_high_atr", "htf_dist_to_prev_day_high_atr",
                  "htf_dist_to_rolling_daily_high_atr"])
    big = lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0]
    new = {
        "interaction_trend_momentum": c("ema_alignment") * c("roc_5"), "interaction_trend_rsi": c("ema_alignment") * c("rsi_from_mid"),
        "interaction_vol_adjusted_momentum": safe_div("roc_5", "atr_ratio_14_50"), "interaction_london_momentum": c("in_london_session") * c("roc_5"),
        "interaction_newyork_momentum": c("in_newyork_session") * c("roc_5"),
        "interaction_bull_reversal_context": c("sweep_low_20") * (c("in_discount_zone") + flag(c("ema_alignment") > 0)),
        "interaction_bear_reversal_context": c("sweep_high_20") * (c("in_premium_zone") + flag(c("ema_alignment") < 0)),
        "interaction_orderflow_return": c("volume_imbalance_10") * c("close_return_1")}
    if htf is not None:
        new |= {"interaction_htf_trend_momentum": htf * c("roc_5"), "interaction_htf_trend_rsi": htf * c("rsi_from_mid"),
                "interaction_htf_ltf_alignment": htf * c("ema_alignment")}
    d = d.withColumns({**new, "interaction_bull_structure_proximity": big(lows), "interaction_bear_structure_proximity": big(highs)})
    out = {}
    for s, other, zone, hl in (("bull", "bear", "in_discount_zone", "low"), ("bear", "bull", "in_premium_zone", "high")):
        p = c(f"interaction_{s}_structure_proximity")
        zname = "discount" if s == "bull" else "premium"
        out |= {f"interaction_{s}_rejection_structure": p * c(f"{s}ish_rejection"), f"interaction_{s}_sweep_structure": p * c(f"sweep_{hl}_20"),
                f"interaction_{s}_{zname}_structure": p * c(zone)}
        rev = mean_of(f"{s}ish_divergence_strength", f"{s}_volume_exhaustion", f"failed_breakout_{other}", p)
        out[f"interaction_compression_{s}_reversion"] = c("compression_regime") * rev
        if "rolling_vol_20_pct_rank_60" in has:
            out[f"interaction_lowvol_{s}_reversion"] = (1.0 - c("rolling_vol_20_pct_rank_60")) * rev
        parts = [p, c(f"{s}ish_rejection"), c(f"{s}_sequence_sweep_displacement_retrace")]
        if htf is not None:
            parts.append(flag(htf > 0 if s == "bull" else htf < 0))
        score = mean_of(*parts)
        out |= {f"interaction_london_{s}_setup": c("in_london_killzone") * score, f"interaction_newyork_{s}_setup": c("in_newyork_killzone") * score,
                f"interaction_overlap_{s}_setup": c("in_london_ny_overlap") * score}
    return d.withColumns(out)


def percent_rank(d: DataFrame, w: Frame, column: str, n: int) -> DataFrame:
    """Average-rank percentile of the last value among its n-row window."""
    win = F.collect_list(column).over(w.rows(-(n - 1), 0))
    less, equal = F.size(F.filter(win, lambda x: x < c(column))), F.size(F.filter(win, lambda x: x == c(column)))
    return d.withColumn(f"{column}_pct_rank_{n}", F.when(F.size(win) == n, (less + (equal + 1) / 2.0) / n))


CORE = (price_action, volatility, trend, momentum, volume, structure, swings)


def with_smooth(bars: DataFrame, weeks: int = 26, warmup: int = 2000) -> DataFrame:
    return with_kernel(bars, smooth, SMOOTH, ["close"], weeks=weeks, warmup=warmup)


def core(bars: DataFrame, extra=(), size: int = BLOCK_ROWS) -> DataFrame:
    """The core families in one block partitioning, the latest swing levels and sweep ages over the whole history, then any extra families."""
    ends = bool(extra) and extra[0] is exhaustion  # it scans for the latest levels itself

    def build(d, w):
        for f in (*CORE, *([pivots] if ends else [])):
            d = f(d, w)
        return d
    d = saved(blocked(with_smooth(bars), build, before=LOOK, after=3, size=size), "core")
    d = d if ends else latest_levels(d, size)
    for f in extra:
        d = f(d, size)
    return d


# name -> (family, families it needs first, bounded look-back rows)
FAMILIES = {"price_action": (price_action, (), 10), "volatility": (volatility, (), 61), "volume": (volume, (), 51), "structure": (structure, ("volatility",), 61),
            "session": (session, (), 0), "microstructure": (microstructure, (), 1), "quality": (quality, ("volatility",), 61), "fractional_diff": (fractional_diff, (), 200),
            "swings": (swings, (), 6)}


def run_sets(bars: DataFrame, names: list[str]) -> DataFrame:
    """Named feature sets with their prerequisites, in one block partitioning; existing columns are never replaced."""
    order: list[str] = []
    for n in names:
        for x in (*FAMILIES[n][1], n):
            if x not in order:
                order.append(x)

    def build(d, w):
        for n in order:
            d = FAMILIES[n][0](d, w)
        return d
    d = blocked(bars, build, before=max(sum(FAMILIES[n][2] for n in order), 1), after=3)
    return structure_ages(d) if "structure" in order else d

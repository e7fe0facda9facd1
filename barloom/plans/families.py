"""FF01-FF18, FF20, FF21 and the WN column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators import features as ff
from barloom.operators.blocks import Frame, blocked, carry_last, with_kernel
from barloom.operators.recursive import wilder_atr
from barloom.plans.registry import (S, TR, query, s_agg, s_div, s_ewm, s_flag, s_lag, s_last, s_lead, s_max, s_mean, s_min, s_since, s_std, s_sum,
                                    shared)

PA = ("close_return_1 close_return_3 close_return_5 close_return_10 log_return_1 candle_body candle_body_pct candle_range upper_wick lower_wick "
      "body_to_range close_location gap_return_1 range_expansion_1 bullish_candle:l bearish_candle:l doji_like:l")
KEY = "symbol:s bar_idx:l "

shared("pa", f"""SELECT *, {s_div('candle_range', s_lag('candle_range'))} AS range_expansion_1, {s_flag('body_to_range < 0.1')} AS doji_like FROM (
 SELECT *, close / {s_lag('close')} - 1 AS close_return_1, close / {s_lag('close', 3)} - 1 AS close_return_3,
 close / {s_lag('close', 5)} - 1 AS close_return_5, close / {s_lag('close', 10)} - 1 AS close_return_10,
 CASE WHEN close / {s_lag('close')} > 0 THEN ln(close / {s_lag('close')}) END AS log_return_1, close - open AS candle_body,
 {s_div('close - open', 'open')} AS candle_body_pct, high - low AS candle_range, high - greatest(open, close) AS upper_wick,
 least(open, close) - low AS lower_wick, {s_div('abs(close - open)', 'high - low')} AS body_to_range,
 {s_div('close - low', 'high - low', 0.5)} AS close_location, {s_div(f"open - {s_lag('close')}", s_lag('close'))} AS gap_return_1,
 {s_flag('close > open')} AS bullish_candle, {s_flag('close < open')} AS bearish_candle FROM bars)""")


@query("ff01_price_action", KEY + PA, "SELECT * FROM pa")
def _(m):
    return blocked(m.bars(), ff.price_action, before=10)


VOL = ("true_range atr_14 atr_50 atr_ratio_14_50 range_atr_14 rolling_vol_20 rolling_vol_60 volatility_expansion_20 bb_width_20 "
       "donchian_width_20 range_shock_20")
shared("vol", f"""SELECT *, {s_div('atr_14', 'atr_50')} AS atr_ratio_14_50, {s_div('high - low', 'atr_14')} AS range_atr_14,
 {s_div('rolling_vol_20', 'rolling_vol_60')} AS volatility_expansion_20, {s_div('_s20 * 4.0', '_m20')} AS bb_width_20,
 {s_div('_hi20 - _lo20', 'atr_14')} AS donchian_width_20, {s_div('high - low', '_r20')} AS range_shock_20 FROM (
 SELECT *, {s_mean('true_range', 14)} AS atr_14, {s_mean('true_range', 50)} AS atr_50, {s_std('close_return_1', 20)} AS rolling_vol_20,
 {s_std('close_return_1', 60)} AS rolling_vol_60, {s_mean('close', 20)} AS _m20, {s_std('close', 20)} AS _s20, {s_max('high', 20)} AS _hi20,
 {s_min('low', 20)} AS _lo20, {s_mean('candle_range', 20)} AS _r20 FROM (SELECT *, {TR} AS true_range FROM pa))""")


@query("ff02_volatility", KEY + VOL, "SELECT * FROM vol")
def _(m):
    valid = m.bars().filter((c("high") >= F.greatest("open", "close", "low")) & (c("low") <= F.least("open", "close", "high")))
    return blocked(valid, ff.volatility, before=61)


TREND = ("ema_8 ema_21 ema_50 ema_200 sma_20 sma_50 close_vs_ema_8_atr close_vs_ema_21_atr close_vs_ema_50_atr close_vs_sma_20_atr "
         "ema_spread_8_21_atr ema_spread_21_50_atr ema_slope_8_3 ema_slope_21_5 ema_alignment:l macd_line macd_signal macd_hist")


def ema(x, n):
    return s_ewm(x, 2.0 / (n + 1.0))


shared("smooth", f"""SELECT *, {ema('macd_line', 9)} AS macd_signal,
 CASE WHEN _al <> 0 THEN 100 - 100 / (1 + _ag / _al) END AS rsi_14 FROM (
 SELECT *, {ema('close', 12)} - {ema('close', 26)} AS macd_line, {s_ewm('_g', 1 / 14, min_periods=14)} AS _ag, {s_ewm('_l', 1 / 14, min_periods=14)} AS _al
 FROM (SELECT *, {ema('close', 8)} AS ema_8, {ema('close', 21)} AS ema_21, {ema('close', 50)} AS ema_50, {ema('close', 200)} AS ema_200,
 greatest(_d, 0) + 0 * _d AS _g, greatest(-_d, 0) + 0 * _d AS _l FROM (SELECT *, close - {s_lag('close')} AS _d FROM vol)))""")
shared("trend", f"""SELECT *, {s_div('close - ema_8', 'atr_14')} AS close_vs_ema_8_atr, {s_div('close - ema_21', 'atr_14')} AS close_vs_ema_21_atr,
 {s_div('close - ema_50', 'atr_14')} AS close_vs_ema_50_atr, {s_div('close - sma_20', 'atr_14')} AS close_vs_sma_20_atr,
 {s_div('ema_8 - ema_21', 'atr_14')} AS ema_spread_8_21_atr, {s_div('ema_21 - ema_50', 'atr_14')} AS ema_spread_21_50_atr,
 {s_div(f"ema_8 - {s_lag('ema_8', 3)}", 'atr_14')} AS ema_slope_8_3, {s_div(f"ema_21 - {s_lag('ema_21', 5)}", 'atr_14')} AS ema_slope_21_5,
 CASE WHEN ema_8 > ema_21 AND ema_21 > ema_50 THEN 1 WHEN ema_8 < ema_21 AND ema_21 < ema_50 THEN -1 ELSE 0 END AS ema_alignment,
 macd_line - macd_signal AS macd_hist FROM (SELECT *, {s_mean('close', 20)} AS sma_20, {s_mean('close', 50)} AS sma_50 FROM smooth)""")


@query("ff03_trend", KEY + TREND, "SELECT * FROM trend")
def _(m):
    return blocked(ff.with_smooth(m.bars()), lambda d, w: ff.trend(ff.volatility(d, w), w), before=80)


MOM = ("rsi_14 rsi_from_mid rsi_delta_3 roc_5 roc_10 momentum_atr_5 stoch_position_14 price_acceleration_3 exhaustion_score")
shared("mom", f"""SELECT *, abs(close_vs_ema_8_atr) * abs(rsi_from_mid) * -coalesce(price_acceleration_3, 0) AS exhaustion_score FROM (
 SELECT *, {s_div('close - _lo14', '_hi14 - _lo14', 0.5)} AS stoch_position_14, roc_5 - {s_lag('roc_5', 3)} AS price_acceleration_3 FROM (
 SELECT *, rsi_14 - 50 AS rsi_from_mid, rsi_14 - {s_lag('rsi_14', 3)} AS rsi_delta_3, close_return_5 AS roc_5, close_return_10 AS roc_10,
 {s_div(f"close - {s_lag('close', 5)}", 'atr_14')} AS momentum_atr_5, {s_min('close', 14)} AS _lo14, {s_max('close', 14)} AS _hi14 FROM trend))""")


@query("ff04_momentum", KEY + MOM, "SELECT * FROM mom")
def _(m):
    return blocked(ff.with_smooth(m.bars()), lambda d, w: ff.momentum(ff.trend(ff.volatility(d, w), w), w), before=80)


VOLU = ("log_volume volume_relative_20 volume_zscore_50 up_volume_share_10 down_volume_share_10 volume_imbalance_10 money_flow_10 dollar_volume")
shared("volu", f"""SELECT *, up_volume_share_10 - down_volume_share_10 AS volume_imbalance_10 FROM (
 SELECT *, {s_div('volume', s_mean('volume', 20))} AS volume_relative_20,
 {s_div(f"log_volume - {s_mean('log_volume', 50)}", s_std('log_volume', 50))} AS volume_zscore_50,
 {s_div(s_sum('_uv', 10), s_sum('volume', 10), 0.5)} AS up_volume_share_10, {s_div(s_sum('_dv', 10), s_sum('volume', 10), 0.5)} AS down_volume_share_10,
 {s_sum('(close - open) * volume', 10)} AS money_flow_10, close * volume AS dollar_volume FROM (
 SELECT *, ln(1 + greatest(volume, 0)) AS log_volume, CASE WHEN _chg > 0 THEN volume ELSE 0.0 END AS _uv, CASE WHEN _chg < 0 THEN volume ELSE 0.0 END AS _dv
 FROM (SELECT *, coalesce(close - {s_lag('close')}, 0) AS _chg FROM bars)))""")


@query("ff05_volume", KEY + VOLU, "SELECT * FROM volu")
def _(m):
    return blocked(m.bars(), ff.volume, before=51)


STR = ("prior_high_20 prior_low_20 prior_high_50 prior_low_50 dist_to_prior_high_20_atr dist_to_prior_low_20_atr dist_to_prior_high_50_atr "
       "dist_to_prior_low_50_atr price_position_50 in_discount_zone:l in_premium_zone:l breakout_high_20:l breakout_low_20:l sweep_high_20:l "
       "sweep_low_20:l bars_since_sweep_high:l bars_since_sweep_low:l displacement_bullish:l displacement_bearish:l structure_pressure:l")


def struct_sql(src):
    strong = "body_to_range > 0.65 AND range_atr_14 > 1.5"
    return f"""SELECT *, {s_flag('price_position_50 < 0.35')} AS in_discount_zone, {s_flag('price_position_50 > 0.65')} AS in_premium_zone,
 {s_since('sweep_high_20 = 1')} AS bars_since_sweep_high, {s_since('sweep_low_20 = 1')} AS bars_since_sweep_low,
 breakout_high_20 - breakout_low_20 AS structure_pressure FROM (
 SELECT *, {s_div('prior_high_20 - close', 'atr_14')} AS dist_to_prior_high_20_atr, {s_div('close - prior_low_20', 'atr_14')} AS dist_to_prior_low_20_atr,
 {s_div('prior_high_50 - close', 'atr_14')} AS dist_to_prior_high_50_atr, {s_div('close - prior_low_50', 'atr_14')} AS dist_to_prior_low_50_atr,
 {s_div('close - prior_low_50', 'prior_high_50 - prior_low_50', 0.5)} AS price_position_50, {s_flag('high > prior_high_20')} AS breakout_high_20,
 {s_flag('low < prior_low_20')} AS breakout_low_20, {s_flag('high > prior_high_20 AND close < prior_high_20')} AS sweep_high_20,
 {s_flag('low < prior_low_20 AND close > prior_low_20')} AS sweep_low_20, {s_flag(f'close > open AND {strong}')} AS displacement_bullish,
 {s_flag(f'close < open AND {strong}')} AS displacement_bearish FROM (
 SELECT *, {s_max('high', 20, 1)} AS prior_high_20, {s_min('low', 20, 1)} AS prior_low_20, {s_max('high', 50, 1)} AS prior_high_50,
 {s_min('low', 50, 1)} AS prior_low_50 FROM {src}))"""


shared("struc", struct_sql("vol"))


@query("ff06_structure", KEY + STR, "SELECT * FROM struc")
def _(m):
    return ff.structure_ages(blocked(m.bars(), lambda d, w: ff.structure(ff.volatility(d, w), w), before=122))


SES = ("hour:l minute:l day_of_week:l month:l hour_sin hour_cos dow_sin dow_cos in_asian_session:l in_london_session:l in_newyork_session:l "
       "in_london_ny_overlap:l in_london_killzone:l in_newyork_killzone:l session_regime:s")


def session_sql(src):
    return f"""SELECT *, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * day_of_week / 7) AS dow_sin,
 cos(2 * pi() * day_of_week / 7) AS dow_cos, {s_flag('in_london_session = 1 AND in_newyork_session = 1')} AS in_london_ny_overlap,
 CASE WHEN in_london_session = 1 AND in_newyork_session = 1 THEN 'overlap' WHEN in_newyork_session = 1 THEN 'new_york'
 WHEN in_london_session = 1 THEN 'london' WHEN in_asian_session = 1 THEN 'asia' ELSE 'off_hours' END AS session_regime FROM (
 SELECT *, hour(_ny) AS hour, minute(_ny) AS minute, isodow(_ny) - 1 AS day_of_week, month(_ny) AS month,
 {s_flag('hour(_ny) >= 19 OR hour(_ny) < 2')} AS in_asian_session, {s_flag('hour(_ld) >= 7 AND hour(_ld) < 16')} AS in_london_session,
 {s_flag('hour(_ny) >= 8 AND hour(_ny) < 17')} AS in_newyork_session, {s_flag('hour(_ny) >= 2 AND hour(_ny) < 5')} AS in_london_killzone,
 {s_flag('hour(_ny) >= 8 AND hour(_ny) < 11')} AS in_newyork_killzone FROM (
 SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS _ny, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS _ld FROM {src}))"""


shared("sess", session_sql("bars"))


@query("ff07_session", KEY + SES, "SELECT * FROM sess")
def _(m):
    return ff.session(m.bars())


MIC = ("approx_spread relative_spread_bps price_impact_proxy amihud_proxy kyle_lambda_proxy order_flow_toxicity intrabar_efficiency range_to_volume "
       "close_location_micro")


@query("ff08_microstructure", KEY + MIC, f"""SELECT *, high - low AS approx_spread, {s_div('high - low', 'close')} * 10000 AS relative_spread_bps,
 {s_div('close - open', 'volume')} AS price_impact_proxy, {s_div('abs(close_return_1)', 'volume')} AS amihud_proxy,
 {s_div('abs(close - open)', 'volume')} AS kyle_lambda_proxy, coalesce(close - {s_lag('close')}, 0) * volume AS order_flow_toxicity,
 {s_div('abs(close - open)', 'high - low')} AS intrabar_efficiency, {s_div('high - low', 'volume')} AS range_to_volume,
 {s_div('close - low', 'high - low', 0.5)} AS close_location_micro FROM pa""")
def _(m):
    return blocked(m.bars(), ff.microstructure, before=1)


QUAL = "anomaly_range_gt_10atr:l close_outside_bar_flag:l open_outside_bar_flag:l range_vs_atr zero_volume_flag:l large_time_gap_flag:l"


@query("ff09_quality", KEY + QUAL, f"""SELECT *, {s_flag('high - low > atr_14 * 10')} AS anomaly_range_gt_10atr,
 {s_flag('close > high OR close < low')} AS close_outside_bar_flag, {s_flag('open > high OR open < low')} AS open_outside_bar_flag,
 {s_div('high - low', 'atr_14')} AS range_vs_atr, {s_flag('volume <= 0')} AS zero_volume_flag,
 {s_flag(f"epoch(ts) - epoch({s_lag('ts')}) > 3600")} AS large_time_gap_flag FROM vol""")
def _(m):
    return blocked(m.bars(), lambda d, w: ff.quality(ff.volatility(d, w), w), before=61)


_FW = ff.frac_weights()
_FWSQL = "[" + ", ".join(repr(x) for x in reversed(_FW)) + "]::DOUBLE[]"
_FWIN = f"OVER ({S} ROWS BETWEEN {len(_FW) - 1} PRECEDING AND CURRENT ROW)"


@query("ff10_fractional_diff", KEY + "fracdiff_close fracdiff_close_return_1", f"""SELECT *, fracdiff_close - {s_lag('fracdiff_close')} AS fracdiff_close_return_1
 FROM (SELECT *, CASE WHEN count(*) {_FWIN} = {len(_FW)} THEN list_dot_product(list(close) {_FWIN}, {_FWSQL}) END AS fracdiff_close FROM bars)""")
def _(m):
    return blocked(m.bars(), ff.fractional_diff, before=len(_FW))


shared("momses", session_sql("mom"))
shared("fullbase", f"""SELECT * EXCLUDE (rn_), {s_flag('lower_wick > abs(close - open) * 1.5 AND close_location > 0.6')} AS bullish_rejection,
 {s_flag('upper_wick > abs(close - open) * 1.5 AND close_location < 0.4')} AS bearish_rejection FROM (
 SELECT m.*, v.log_volume, v.volume_relative_20, v.volume_zscore_50, v.up_volume_share_10, v.down_volume_share_10, v.volume_imbalance_10,
 v.money_flow_10, v.dollar_volume, 1 AS rn_ FROM ({struct_sql('momses')}) m JOIN volu v USING (symbol, bar_idx))""")

_R3 = f"OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
shared("swings", f"""SELECT *, {s_last('swing_high_level')} AS latest_swing_high, {s_last('swing_low_level')} AS latest_swing_low FROM (
 SELECT *, coalesce({s_lag('raw_swing_high', 3)}, 0) AS confirmed_swing_high, coalesce({s_lag('raw_swing_low', 3)}, 0) AS confirmed_swing_low,
 CASE WHEN {s_lag('raw_swing_high', 3)} = 1 THEN {s_lag('high', 3)} END AS swing_high_level,
 CASE WHEN {s_lag('raw_swing_low', 3)} = 1 THEN {s_lag('low', 3)} END AS swing_low_level FROM (
 SELECT *, {s_flag(f"high > {s_max('high', 3, 1)} AND count(*) {_R3} = 3 AND high > max(high) {_R3}")} AS raw_swing_high,
 {s_flag(f"low < {s_min('low', 3, 1)} AND count(*) {_R3} = 3 AND low < min(low) {_R3}")} AS raw_swing_low FROM fullbase))""")

EXH = ("return_slope_3 return_slope_8 return_slope_decay_3_8 return_slope_decay_8_21 rsi_slope_3 rsi_slope_8 rsi_slope_decay_3_8 rsi_slope_decay_8_21 "
       "distance_from_bull_origin_atr distance_from_bear_origin_atr bullish_divergence_event:l bearish_divergence_event:l bullish_divergence_strength "
       "bearish_divergence_strength bars_since_bullish_divergence:l bars_since_bearish_divergence:l range_compression_10_50 "
       "volatility_compression_10_50 compression_regime:l range_expansion_shock_10 bull_volume_exhaustion bear_volume_exhaustion "
       "failed_breakout_bull:l failed_breakout_bear:l failed_continuation_bull:l failed_continuation_bear:l")
_HI, _LO = "swing_high_level IS NOT NULL AND _hr IS NOT NULL", "swing_low_level IS NOT NULL AND _lr IS NOT NULL"
shared("exh", f"""SELECT *, {s_since('bullish_divergence_event = 1')} AS bars_since_bullish_divergence,
 {s_since('bearish_divergence_event = 1')} AS bars_since_bearish_divergence FROM (
 SELECT *, return_slope_3 - return_slope_8 AS return_slope_decay_3_8, return_slope_8 - _s21 AS return_slope_decay_8_21,
 rsi_slope_3 - rsi_slope_8 AS rsi_slope_decay_3_8, rsi_slope_8 - _q21 AS rsi_slope_decay_8_21,
 {s_flag(f'{_LO} AND swing_low_level < _plp AND _lr > _plr')} AS bullish_divergence_event,
 {s_flag(f'{_HI} AND swing_high_level > _php AND _hr < _phr')} AS bearish_divergence_event,
 CASE WHEN {_LO} AND swing_low_level < _plp AND _lr > _plr THEN (_plp - swing_low_level) / _sc * ((_lr - _plr) / 50.0) ELSE 0.0 END AS bullish_divergence_strength,
 CASE WHEN {_HI} AND swing_high_level > _php AND _hr < _phr THEN (swing_high_level - _php) / _sc * ((_phr - _hr) / 50.0) ELSE 0.0 END AS bearish_divergence_strength,
 {s_flag('range_compression_10_50 < 0.8 AND volatility_compression_10_50 < 0.8')} AS compression_regime,
 CASE WHEN distance_from_bull_origin_atr IS NOT NULL AND _fade IS NOT NULL AND rsi_14 IS NOT NULL THEN
 greatest(distance_from_bull_origin_atr, 0) * greatest(_fade, 0) * greatest(rsi_14 - 50, 0) / 50 END AS bull_volume_exhaustion,
 CASE WHEN distance_from_bear_origin_atr IS NOT NULL AND _fade IS NOT NULL AND rsi_14 IS NOT NULL THEN
 greatest(distance_from_bear_origin_atr, 0) * greatest(_fade, 0) * greatest(50 - rsi_14, 0) / 50 END AS bear_volume_exhaustion,
 {s_flag('_bh = 1 AND close < prior_high_20')} AS failed_breakout_bull, {s_flag('_bl = 1 AND close > prior_low_20')} AS failed_breakout_bear,
 {s_flag(f"{s_lag('_bh')} = 1 AND close < prior_high_20")} AS failed_continuation_bull,
 {s_flag(f"{s_lag('_bl')} = 1 AND close > prior_low_20")} AS failed_continuation_bear FROM (
 SELECT *, {s_last(f'CASE WHEN {_HI} THEN swing_high_level END', strict=True)} AS _php, {s_last(f'CASE WHEN {_HI} THEN _hr END', strict=True)} AS _phr,
 {s_last(f'CASE WHEN {_LO} THEN swing_low_level END', strict=True)} AS _plp, {s_last(f'CASE WHEN {_LO} THEN _lr END', strict=True)} AS _plr,
 CASE WHEN {s_last('atr_14')} > 0 THEN {s_last('atr_14')} ELSE 1.0 END AS _sc,
 {s_mean('close_return_1', 3)} AS return_slope_3, {s_mean('close_return_1', 8)} AS return_slope_8, {s_mean('close_return_1', 21)} AS _s21,
 (rsi_14 - {s_lag('rsi_14', 3)}) / 3 AS rsi_slope_3, (rsi_14 - {s_lag('rsi_14', 8)}) / 8 AS rsi_slope_8, (rsi_14 - {s_lag('rsi_14', 21)}) / 21 AS _q21,
 {s_div('close - latest_swing_low', 'atr_14')} AS distance_from_bull_origin_atr, {s_div('latest_swing_high - close', 'atr_14')} AS distance_from_bear_origin_atr,
 {s_div(s_mean('candle_range', 10), s_mean('candle_range', 50))} AS range_compression_10_50,
 {s_div(s_std('close_return_1', 10), s_std('close_return_1', 50))} AS volatility_compression_10_50,
 {s_div('candle_range', s_mean('candle_range', 10))} AS range_expansion_shock_10,
 -({s_mean('volume_relative_20', 3)} - ({s_mean('volume_relative_20', 10)})) AS _fade,
 {s_flag('high > prior_high_20')} AS _bh, {s_flag('low < prior_low_20')} AS _bl FROM (
 SELECT *, CASE WHEN {s_lag('raw_swing_high', 3)} = 1 THEN {s_lag('rsi_14', 3)} END AS _hr,
 CASE WHEN {s_lag('raw_swing_low', 3)} = 1 THEN {s_lag('rsi_14', 3)} END AS _lr FROM swings)))""")


@query("ff12_exhaustion", KEY + EXH, "SELECT * FROM exh")
def _(m):
    return ff.core(m.bars(), (ff.exhaustion,))


TMP = ("bullish_rejection:l bearish_rejection:l bars_since_last_sweep:l bars_since_last_bos:l bars_since_last_displacement:l bars_since_last_rejection:l "
       "cooldown_since_major_event:l major_event_density_10 major_event_density_25 major_event_cluster_10:l major_event_cluster_25:l swing_density_20 "
       "swing_density_50 bull_sequence_sweep_displacement:l bear_sequence_sweep_displacement:l in_london_early:l in_london_mid:l in_london_late:l "
       "in_newyork_early:l in_newyork_mid:l in_newyork_late:l")


def ordered(a, b):
    return f"{a} >= 0 AND {b} > {a} AND bar_idx - {b} <= 10 AND {b} - {a} <= 8"


def lastidx(cond):
    return f"coalesce({s_last(f'CASE WHEN {cond} THEN bar_idx END')}, -1)"


_DISP = "displacement_bullish = 1 OR displacement_bearish = 1"
_SWP, _REJ = "sweep_high_20 = 1 OR sweep_low_20 = 1", "bullish_rejection = 1 OR bearish_rejection = 1"
shared("tmp", f"""SELECT *, {s_flag(ordered('_lsl', '_ldb'))} AS bull_sequence_sweep_displacement, {s_flag(ordered('_lsh', '_lds'))} AS bear_sequence_sweep_displacement FROM (
 SELECT *, {s_since(_SWP)} AS bars_since_last_sweep, CAST(NULL AS BIGINT) AS bars_since_last_bos, {s_since(_DISP)} AS bars_since_last_displacement,
 {s_since(_REJ)} AS bars_since_last_rejection, {s_since('_mj = 1')} AS cooldown_since_major_event,
 avg(_mj) OVER ({S} ROWS 9 PRECEDING) AS major_event_density_10, avg(_mj) OVER ({S} ROWS 24 PRECEDING) AS major_event_density_25,
 sum(_mj) OVER ({S} ROWS 9 PRECEDING) AS major_event_cluster_10, sum(_mj) OVER ({S} ROWS 24 PRECEDING) AS major_event_cluster_25,
 avg(_sw) OVER ({S} ROWS 19 PRECEDING) AS swing_density_20, avg(_sw) OVER ({S} ROWS 49 PRECEDING) AS swing_density_50,
 {lastidx('sweep_low_20 = 1')} AS _lsl, {lastidx('sweep_high_20 = 1')} AS _lsh, {lastidx('displacement_bullish = 1')} AS _ldb,
 {lastidx('displacement_bearish = 1')} AS _lds, in_london_killzone AS in_london_early,
 {s_flag('in_london_session = 1 AND in_london_killzone = 0 AND hour < 8')} AS in_london_mid,
 {s_flag('in_london_session = 1 AND in_london_killzone = 0 AND hour >= 8')} AS in_london_late, in_newyork_killzone AS in_newyork_early,
 {s_flag('hour >= 11 AND hour < 14 AND in_newyork_session = 1')} AS in_newyork_mid, {s_flag('hour >= 14 AND in_newyork_session = 1')} AS in_newyork_late
 FROM (SELECT *, {s_flag(f'{_SWP} OR {_DISP} OR {_REJ}')} AS _mj, {s_flag('confirmed_swing_high = 1 OR confirmed_swing_low = 1')} AS _sw FROM exh))""")


@query("ff13_temporal_context", KEY + TMP, "SELECT * FROM tmp")
def _(m):
    return ff.core(m.bars(), (ff.exhaustion, ff.session, ff.temporal))


PULL = " ".join(f"continuation_{s}_{x}" for s in ("bull", "bear") for x in (
    "impulse_event:l", "impulse_magnitude_atr", "pullback_depth_atr", "pullback_depth_ratio", "pullback_active:l", "pullback_channel_slope_8_atr",
    "retest_quality", "wick_rejection_score", "resume_event:l")) + " " + " ".join(
    f"continuation_bars_since_{s}_{x}:l" for s in ("bull", "bear") for x in ("impulse", "resume"))


def dq(x):
    return f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN 0.0 WHEN {x} < 0.15 THEN {x} / 0.15 WHEN {x} <= 0.65 THEN 1.0 WHEN {x} <= 1 THEN 1 - ({x} - 0.65) / 0.35 ELSE 0.0 END"


def prox(x, t=2.0):
    return f"coalesce(1.0 - CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, 0), {t}) END / {t}, 0)"


def pull_side(s):
    b = s == "bull"
    tr, pk, orig = ("_bt", "_bpk", "_bor") if b else ("_st", "_spk", "_sor")
    e = "high" if b else "low"
    mag = f"greatest({'_pk - _or' if b else '_or - _pk'}, 0) / _a"
    dep = f"greatest({'_pk - low' if b else 'high - _pk'}, 0) / _a"
    fl = "close_vs_ema_21_atr" if b else "-close_vs_ema_21_atr"
    wk = "lower_wick" if b else "upper_wick"
    loc = "close_location" if b else "(1 - close_location)"
    isl = "PARTITION BY symbol, _at ORDER BY bar_idx ROWS UNBOUNDED PRECEDING"
    ev = f"continuation_{s}_impulse_event"
    imp = (f"ema_alignment > 0 AND (displacement_bullish = 1 OR breakout_high_20 = 1) AND close > open AND close_location > 0.55" if b else
           f"ema_alignment < 0 AND (displacement_bearish = 1 OR breakout_low_20 = 1) AND close < open AND close_location < 0.45")
    res = (f"_tr = 1 AND _rec = 1 AND close > open AND close_location > 0.55 AND (coalesce(close > _x3, false) OR displacement_bullish = 1 OR breakout_high_20 = 1)" if b else
           f"_tr = 1 AND _rec = 1 AND close < open AND close_location < 0.45 AND (coalesce(close < _x3, false) OR displacement_bearish = 1 OR breakout_low_20 = 1)")
    return f"""SELECT symbol, bar_idx, {ev}, _mag AS continuation_{s}_impulse_magnitude_atr, _dep AS continuation_{s}_pullback_depth_atr,
 _rat AS continuation_{s}_pullback_depth_ratio, _act AS continuation_{s}_pullback_active, _si AS continuation_bars_since_{s}_impulse,
 CASE WHEN _act = 1 THEN _slp ELSE 0 END AS continuation_{s}_pullback_channel_slope_8_atr,
 CASE WHEN _act = 1 THEN ({prox('abs(close_vs_ema_21_atr)', 1.25)} + {prox('abs(close - _lv) / _a', 1.5)}
 + coalesce(CASE WHEN close_vs_ema_21_atr IS NOT NULL THEN least(greatest(({fl} + 0.75) / 1.5, 0), 1) END, 0) + {dq('_rat')}) / 4 ELSE 0 END AS continuation_{s}_retest_quality,
 {s_div(wk, 'high - low', 0.0)} * {loc} * (1 - {s_div('abs(close - open)', 'high - low', 0.0)}) * _act AS continuation_{s}_wick_rejection_score,
 {s_flag(res)} AS continuation_{s}_resume_event, {s_since(res)} AS continuation_bars_since_{s}_resume FROM (
 SELECT *, max(_act) OVER ({S} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS _rec FROM (
 SELECT *, {s_flag(f'_tr = 1 AND _spk2 BETWEEN 1 AND 48 AND _mag >= 0.25 AND _dep >= 0.10 AND _rat <= 1.25')} AS _act FROM (
 SELECT *, CASE WHEN _mag > 1e-9 THEN _dep / _mag END AS _rat FROM (
 SELECT *, CASE WHEN _a > 0 AND _at IS NOT NULL THEN {mag} END AS _mag, CASE WHEN _a > 0 AND _at IS NOT NULL THEN {dep} END AS _dep,
 CASE WHEN _a > 0 AND _at IS NOT NULL THEN bar_idx - _at END AS _si, CASE WHEN _a > 0 AND _at IS NOT NULL THEN bar_idx - _pi END AS _spk2 FROM (
 SELECT *, last_value(CASE WHEN {e} = _pk THEN bar_idx END IGNORE NULLS) OVER ({isl}) AS _pi FROM (
 SELECT *, CASE WHEN _at IS NOT NULL THEN {'max' if b else 'min'}({e}) OVER ({isl}) END AS _pk FROM (
 SELECT *, {s_last(f'CASE WHEN {ev} = 1 THEN bar_idx END')} AS _at, {s_last(f"CASE WHEN {ev} = 1 THEN coalesce(latest_swing_{'low' if b else 'high'}, _fall) END")} AS _or,
 {s_last(f"CASE WHEN {ev} = 1 THEN coalesce(prior_{'high' if b else 'low'}_20, close) END")} AS _lv,
 CASE WHEN _slope IS NOT NULL THEN greatest({'-_slope' if b else '_slope'}, 0) END AS _slp FROM (
 SELECT *, {s_flag(f"_imp = 1 AND coalesce({s_lag('_imp')}, 0) = 0")} AS {ev}, {s_div(f"_sm - {s_lag('_sm', 8)}", '_a * 8')} AS _slope FROM (
 SELECT *, {s_flag(imp)} AS _imp, {s_flag('ema_alignment > 0' if b else 'ema_alignment < 0')} AS _tr, CASE WHEN atr_14 <> 0 THEN atr_14 END AS _a,
 {'min(low)' if b else 'max(high)'} OVER ({S} ROWS 6 PRECEDING) AS _fall, avg(close) OVER ({S} ROWS 2 PRECEDING) AS _sm,
 {s_max('high', 3, 1) if b else s_min('low', 3, 1)} AS _x3 FROM swings)))))))))"""


@query("ff14_continuation_pullback", KEY + PULL, f"SELECT * FROM ({pull_side('bull')}) JOIN ({pull_side('bear')}) USING (symbol, bar_idx)")
def _(m):
    return ff.core(m.bars(), (ff.pullback,))


# ---- window transforms ------------------------------------------------------------------------------------------------------
@query("wn01_lag_features", KEY + "close_lag_1 close_lag_3 volume_lag_1 volume_lag_3",
       f"SELECT *, {s_lag('close')} AS close_lag_1, {s_lag('close', 3)} AS close_lag_3, {s_lag('volume')} AS volume_lag_1, {s_lag('volume', 3)} AS volume_lag_3 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: d.withColumns({f"{x}_lag_{k}": w.lag(x, k) for x in ("close", "volume") for k in (1, 3)}), before=3)


@query("wn02_returns", KEY + "ret_1 ret_5 diff_1 diff_5 log_ret accel_5",
       f"""SELECT *, ret_5 - {s_lag('ret_5', 3)} AS accel_5 FROM (SELECT *, close / {s_lag('close')} - 1 AS ret_1, close / {s_lag('close', 5)} - 1 AS ret_5,
 close - {s_lag('close')} AS diff_1, close - {s_lag('close', 5)} AS diff_5, ln(close / {s_lag('close')}) AS log_ret FROM bars)""")
def _(m):
    def build(d, w):
        d = d.withColumns({"ret_1": ff.pct(w, "close"), "ret_5": ff.pct(w, "close", 5), "diff_1": c("close") - w.lag("close"),
                           "diff_5": c("close") - w.lag("close", 5), "log_ret": F.log(c("close") / w.lag("close"))})
        return d.withColumn("accel_5", c("ret_5") - w.lag("ret_5", 3))
    return blocked(m.bars(), build, before=8)


_RS = [5, 10, 20, 50]


@query("wn03_rolling_statistics", "symbol:s bar_idx:l " + " ".join(f"close_roll_mean_{n}:d4 close_roll_std_{n}:d4" for n in _RS),
       "SELECT *, " + ", ".join(f"{s_mean('close', n)} AS close_roll_mean_{n}, {s_std('close', n)} AS close_roll_std_{n}" for n in _RS) + " FROM daily")
def _(m):
    return blocked(m.daily(), lambda d, w: d.withColumns({k: v for n in _RS for k, v in
                                                         ((f"close_roll_mean_{n}", w.mean("close", n)), (f"close_roll_std_{n}", w.std("close", n)))}), before=50)


@query("wn04_exact_rolling_mean_std", KEY + "volume_mean_3 volume_std_3",
       f"SELECT *, {s_mean('volume', 3)} AS volume_mean_3, {s_std('volume', 3)} AS volume_std_3 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: d.withColumns({"volume_mean_3": w.mean("volume", 3), "volume_std_3": w.std("volume", 3)}), before=3)


_ZM, _ZS = s_mean("close", 50), s_std("close", 50)


@query("wn05_rolling_zscore", KEY + "close_zscore_50", f"SELECT *, {s_div(f'close - ({_ZM})', _ZS)} AS close_zscore_50 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: d.withColumns({"_m": w.mean("close", 50), "_s": w.std("close", 50)})
                   .withColumn("close_zscore_50", ff.safe_div(c("close") - c("_m"), "_s")), before=50)


_SM, _SS = s_mean("close", 20, 1), s_std("close", 20, 1)


@query("wn06_sigma_normalize", KEY + "close_sigma_norm_20", f"SELECT *, {s_div(f'close - ({_SM})', _SS)} AS close_sigma_norm_20 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: d.withColumns({"_m": w.mean("close", 20, 1), "_s": w.std("close", 20, 1)})
                   .withColumn("close_sigma_norm_20", ff.safe_div(c("close") - c("_m"), "_s")), before=21)


_QW = f"OVER ({S} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


@query("wn07_rolling_winsorize", KEY + "ret ret_winsor_60", f"""SELECT *, CASE WHEN lo IS NULL OR ret IS NULL THEN ret ELSE greatest(least(ret, hi), lo) END AS ret_winsor_60 FROM (
 SELECT *, CASE WHEN count(ret) {_QW} = 60 THEN quantile_cont(ret, 0.01) {_QW} END AS lo, CASE WHEN count(ret) {_QW} = 60 THEN quantile_cont(ret, 0.99) {_QW} END AS hi
 FROM (SELECT *, close / {s_lag('close')} - 1 AS ret FROM bars))""")
def _(m):
    def build(d, w):
        win = w.rows(-60, -1)
        d = d.withColumn("ret", ff.pct(w, "close"))
        d = d.withColumn("_q", F.when(F.count("ret").over(win) == 60, F.percentile("ret", F.array(F.lit(0.01), F.lit(0.99))).over(win)))
        return d.withColumn("ret_winsor_60", F.when(c("_q").isNull() | c("ret").isNull(), c("ret"))
                            .otherwise(F.greatest(F.least("ret", c("_q")[1]), c("_q")[0])))
    return blocked(m.bars(), build, before=62)


def s_rank(x, n):
    o = f"OVER ({S} ROWS {n - 1} PRECEDING)"
    return (f"CASE WHEN count({x}) {o} = {n} THEN (len(list_filter(list({x}) {o}, lambda z: z < {x})) + "
            f"(len(list_filter(list({x}) {o}, lambda z: z = {x})) + 1) / 2.0) / {n} END")


@query("wn08_rolling_percent_rank", KEY + "close_pct_rank_60", f"SELECT *, {s_rank('close', 60)} AS close_pct_rank_60 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: ff.percent_rank(d, w, "close", 60), before=60)


@query("wn09_atr_normalize", KEY + "candle_body_atr_norm candle_range_atr_norm",
       f"SELECT *, {s_div('candle_body', 'atr_14')} AS candle_body_atr_norm, {s_div('candle_range', 'atr_14')} AS candle_range_atr_norm FROM vol")
def _(m):
    return blocked(m.bars(), lambda d, w: ff.volatility(d, w).withColumns({
        "candle_body_atr_norm": ff.safe_div(c("close") - c("open"), "atr_14"), "candle_range_atr_norm": ff.safe_div(c("high") - c("low"), "atr_14")}), before=61)


@query("wn10_true_range_atr", KEY + "true_range atr_14 atr_50", "SELECT * FROM vol")
def _(m):
    def build(d, w):
        d = d.withColumn("true_range", ff.true_range(w))
        return d.withColumns({"atr_14": w.mean("true_range", 14), "atr_50": w.mean("true_range", 50)})
    return blocked(m.bars(), build, before=51)


shared("satr", f"SELECT *, {s_ewm('true_range', 1 / 14, min_periods=14)} AS satr FROM vol")


@query("wn11_wilder_atr", KEY + "satr", "SELECT * FROM satr")
def _(m):
    return with_kernel(m.bars(), wilder_atr(14), "satr double", ["high", "low", "close"], weeks=26)


@query("wn12_ema", KEY + "ema_21 ema_50", "SELECT * FROM smooth")
def _(m):
    return ff.with_smooth(m.bars())


@query("wn13_rsi", KEY + "rsi_14", "SELECT * FROM smooth")
def _(m):
    return ff.with_smooth(m.bars())


_F6 = ff.frac_weights(0.6, 1e-2, 50)
_O6 = f"OVER ({S} ROWS BETWEEN {len(_F6) - 1} PRECEDING AND CURRENT ROW)"


@query("wn14_fractional_diff", KEY + "fracdiff_close",
       f"SELECT *, CASE WHEN count(*) {_O6} = {len(_F6)} THEN list_dot_product(list(close) {_O6}, [{', '.join(repr(x) for x in reversed(_F6))}]::DOUBLE[]) END AS fracdiff_close FROM daily")
def _(m):
    return blocked(m.daily(), lambda d, w: ff.fractional_diff(d, w, 0.6, 1e-2, 50), before=50)


@query("wn15_bars_since_event", KEY + "since_up:l since_down:l", f"""SELECT *, {s_since('r > 1')} AS since_up, {s_since('r < -0.5')} AS since_down FROM (
 SELECT *, close / {s_lag('close')} - 1 AS r FROM daily)""")
def _(m):
    r = blocked(m.daily(), lambda d, w: d.withColumn("r", ff.pct(w, "close")), before=1)
    out = carry_last(r, {"_u": F.when(c("r") > 1, c("bar_idx")), "_d": F.when(c("r") < -0.5, c("bar_idx"))})
    return out.withColumns({"since_up": c("bar_idx") - c("_u"), "since_down": c("bar_idx") - c("_d")})


@query("wn16_swing_pivots", KEY + "raw_swing_high:l raw_swing_low:l", "SELECT * FROM swings")
def _(m):
    return blocked(m.bars(), ff.swings, before=3, after=3)


@query("wn17_confirmed_swings", KEY + "confirmed_swing_high:l confirmed_swing_low:l swing_high_level swing_low_level latest_swing_high latest_swing_low",
       "SELECT * FROM swings")
def _(m):
    d = blocked(m.bars(), ff.swings, before=6, after=0).drop("latest_swing_high", "latest_swing_low")
    return carry_last(d, {"latest_swing_high": c("swing_high_level"), "latest_swing_low": c("swing_low_level")})

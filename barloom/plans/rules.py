"""TS01-TS19, FF16 and the UD registry rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators import features as ff
from barloom.operators import strategies as st
from barloom.operators.blocks import blocked, carry_last, chained
from barloom.operators.recursive import adaptive, parabolic
from barloom.plans.registry import (S, TR, over, query, s_div, s_flag, s_lag, s_last, s_max, s_mean, s_min, s_std, s_sum)

KEY = "symbol:s bar_idx:l "


def sd(up, dn):
    return f"CASE WHEN {up} THEN 'long' WHEN {dn} THEN 'short' ELSE 'neutral' END"


def run(m, fn, before, smooth=False, **kw):
    src = ff.with_smooth(m.bars()) if smooth else m.bars()
    return blocked(src, lambda d, w: fn(d, w, **kw), before=before)


def s_wma(n):
    o = f"OVER ({S} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(*) {o} = {n} THEN list_dot_product(list(close) {o}, {[float(k) for k in range(1, n + 1)]}::DOUBLE[]) / {n * (n + 1) / 2.0} END"


def s_cross(f, s, nm, src="bars"):
    return (f"SELECT *, {sd(f'{nm}_state = 1 AND coalesce(p, 0) <> 1', f'{nm}_state = -1 AND coalesce(p, 0) <> -1')} AS {nm}_signal FROM (SELECT *, lag({nm}_state) OVER ({S}) AS p FROM ("
            f"SELECT *, CASE WHEN f > s THEN 1 WHEN f < s THEN -1 ELSE 0 END AS {nm}_state FROM (SELECT *, {f} AS f, {s} AS s FROM {src})))")


@query("ts01_moving_average_cross", KEY + "sma_state:l sma_signal:s wma_state:l wma_signal:s ema_state:l ema_signal:s",
       f"SELECT a.*, b.wma_state, b.wma_signal, e.ema_state, e.ema_signal FROM ({s_cross(s_mean('close', 5), s_mean('close', 20), 'sma')}) a JOIN ({s_cross(s_wma(13), s_wma(26), 'wma')}) b USING (symbol, bar_idx) JOIN ({s_cross('ema_8', 'ema_21', 'ema', 'smooth')}) e USING (symbol, bar_idx)")
def _(m):
    def build(d, w):
        d = st.ma_cross(d, w, 5, 20, "sma", "sma")
        d = st.ma_cross(d, w, 13, 26, "wma", "wma")
        return st.ma_cross(d, w, 8, 21, "ema", "ema")
    return run(m, build, 28, smooth=True)


_EM = s_mean("close", 20)


@query("ts02_price_vs_average", KEY + "envelope_signal:s", f"SELECT *, {sd('close > m * 1.25', 'close < m * 0.75')} AS envelope_signal FROM (SELECT *, {_EM} AS m FROM bars)")
def _(m):
    return run(m, st.envelope, 20)


_FAST, _SLOW = 2.0 / 3.0, 2.0 / 31.0


@query("ts02_adaptive_average", KEY + "kama kama_signal:s", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT symbol, bar_idx, close, {s_lag('close')} AS pv, CASE WHEN bar_idx >= 10 THEN
 pow(CASE WHEN v > 0 THEN abs(close - c10) / v ELSE 0.0 END * {_FAST - _SLOW!r}::DOUBLE + {_SLOW!r}::DOUBLE, 2) END AS w FROM (SELECT *, {s_lag('close', 10)} AS c10, sum(d) {over(10)} AS v FROM (
 SELECT *, abs(close - {s_lag('close')}) AS d FROM bars))), k AS (SELECT symbol, bar_idx, close, CAST(NULL AS DOUBLE) AS kama FROM t WHERE bar_idx = 0 UNION ALL
 SELECT t.symbol, t.bar_idx, t.close, CASE WHEN t.w IS NOT NULL THEN coalesce(k.kama, t.pv) + t.w * (t.close - coalesce(k.kama, t.pv)) END FROM k JOIN t ON t.symbol = k.symbol AND t.bar_idx = k.bar_idx + 1)
 SELECT *, {sd('close > kama', 'close < kama')} AS kama_signal FROM k""")
def _(m):
    def weigh(d, w):
        d = d.withColumns({"before": w.lag("close"), "_d": F.abs(c("close") - w.lag("close"))})
        er = F.when(w.sum("_d", 10) > 0, F.abs(c("close") - w.lag("close", 10)) / w.sum("_d", 10)).otherwise(0.0)
        return d.withColumn("weight", F.when(c("bar_idx") >= 10, F.pow(er * (_FAST - _SLOW) + _SLOW, F.lit(2.0)))).drop("_d")

    def run_(p, state):
        out, left = adaptive(p["close"].tolist(), p["before"].astype(float).tolist(), p["weight"].astype(float).tolist(), state)
        return {"kama": out, "x": p["close"]}, left
    k = chained(blocked(m.bars(), weigh, before=11), run_, [float("nan")], "kama double, x double", ["close", "before", "weight"])
    return k.withColumns({"kama": F.when(~F.isnan("kama"), c("kama"))}).withColumn("kama_signal", st.side(c("x") > c("kama"), c("x") < c("kama")))


@query("ts03_rsi_rules", KEY + "rsi_simple rsi_signal:s", f"""SELECT *, {sd(f"rsi_simple > 30 AND {s_lag('rsi_simple')} <= 30", f"rsi_simple < 70 AND {s_lag('rsi_simple')} >= 70")} AS rsi_signal FROM (
 SELECT *, CASE WHEN dn <> 0 THEN 100 - 100 / (1 + up / dn) END AS rsi_simple FROM (SELECT *, {s_mean('u', 14)} AS up, {s_mean('d', 14)} AS dn FROM (
 SELECT *, CASE WHEN g IS NOT NULL THEN greatest(g, 0) END AS u, CASE WHEN g IS NOT NULL THEN greatest(-g, 0) END AS d FROM (SELECT *, close - {s_lag('close')} AS g FROM bars))))""")
def _(m):
    return run(m, st.rsi_levels, 17)


@query("ts04_double_smoothed", KEY + "ppo macd_signal_side:s", f"""SELECT *, {s_div('ema_8 - ema_21', 'ema_21')} * 100 AS ppo, {sd(f"x > 0 AND {s_lag('x')} <= 0", f"x < 0 AND {s_lag('x')} >= 0")} AS macd_signal_side
 FROM (SELECT *, macd_line - macd_signal AS x FROM smooth)""")
def _(m):
    return run(m, st.macd_rules, 2, smooth=True)


@query("ts05_range_position", KEY + "stoch_k stoch_d williams_r stoch_signal:s", f"""SELECT *, {sd('stoch_d < 20 AND stoch_k > stoch_d', 'stoch_d > 80 AND stoch_k < stoch_d')} AS stoch_signal FROM (
 SELECT *, {s_mean('stoch_k', 3)} AS stoch_d FROM (SELECT *, {s_div('close - l', 'h - l')} * 100 AS stoch_k, {s_div('h - close', 'h - l')} * -100 AS williams_r FROM (SELECT *, {s_max('high', 14)} AS h, {s_min('low', 14)} AS l FROM bars)))""")
def _(m):
    return run(m, st.stochastic, 18)


@query("ts06_deviation_bands", KEY + "bb_low bb_high percent_b bb_signal:s", f"""SELECT *, {s_div('close - bb_low', 'bb_high - bb_low')} AS percent_b,
 {sd(f"close > bb_low AND {s_lag('close')} <= {s_lag('bb_low')}", f"close < bb_high AND {s_lag('close')} >= {s_lag('bb_high')}")} AS bb_signal FROM (SELECT *, m - 2 * s AS bb_low, m + 2 * s AS bb_high FROM (
 SELECT *, {s_mean('close', 20)} AS m, {s_std('close', 20)} AS s FROM bars))""")
def _(m):
    return run(m, st.bollinger, 22)


@query("ts07_atr_bands", KEY + "keltner_signal:s", f"""SELECT *, {sd('close > m + a', 'close < m - a')} AS keltner_signal FROM (SELECT *, {s_mean('close', 20)} AS m, {s_mean('tr', 14)} AS a FROM (SELECT *, {TR} AS tr FROM bars))""")
def _(m):
    return run(m, st.keltner, 21)


@query("ts08_channel_breakout", KEY + "donchian_signal:s", f"SELECT *, {sd('high > h', 'low < l')} AS donchian_signal FROM (SELECT *, {s_max('high', 20, 1)} AS h, {s_min('low', 20, 1)} AS l FROM bars)")
def _(m):
    return run(m, st.breakout, 21)


_W15 = f"OVER ({S} ROWS 14 PRECEDING)"
_AU = f"CASE WHEN count(*) {_W15} = 15 THEN (14 - (bar_idx - list_max(list_transform(list_filter(list(row(high, bar_idx)) {_W15}, lambda z: z[1] = mx), lambda z: z[2])))) * 100.0 / 14 END"
_AD = f"CASE WHEN count(*) {_W15} = 15 THEN (14 - (bar_idx - list_max(list_transform(list_filter(list(row(low, bar_idx)) {_W15}, lambda z: z[1] = mn), lambda z: z[2])))) * 100.0 / 14 END"


@query("ts09_trend_strength", KEY + "efficiency vhf aroon_up aroon_down aroon_signal:s", f"""SELECT *, {sd('aroon_up > 70 AND aroon_down < 30', 'aroon_down > 70 AND aroon_up < 30')} AS aroon_signal FROM (
 SELECT *, {s_div(f"abs(close - {s_lag('close', 14)})", s_sum('step', 14))} AS efficiency, {s_div(f"({s_max('close', 14)}) - ({s_min('close', 14)})", s_sum('step', 14))} AS vhf, {_AU} AS aroon_up, {_AD} AS aroon_down FROM (
 SELECT *, abs(close - {s_lag('close')}) AS step, max(high) {_W15} AS mx, min(low) {_W15} AS mn FROM bars))""")
def _(m):
    return run(m, st.trend_strength, 16)


_O20 = f"OVER ({S} ROWS 19 PRECEDING)"


@query("ts10_window_momentum", KEY + "cci roc_12 dpo cci_signal:s", f"""SELECT *, {sd('cci > 100', 'cci < -100')} AS cci_signal FROM (SELECT *, {s_div('tp - mm', '0.015 * list_avg(list_transform(box, lambda v: abs(v - mm)))')} AS cci FROM (
 SELECT *, list(tp) {_O20} AS box, {s_mean('tp', 20)} AS mm, (close / {s_lag('close', 12)} - 1) * 100 AS roc_12, {s_lag('close', 11)} - ({s_mean('close', 20)}) AS dpo FROM (SELECT *, (high + low + close) / 3.0 AS tp FROM bars)))""")
def _(m):
    return run(m, st.window_momentum, 22)


@query("ts11_volume_flow", KEY + "cmf mfi vwma force_index cmf_signal:s", f"""SELECT *, {sd('cmf > 0.05', 'cmf < -0.05')} AS cmf_signal FROM (SELECT *, {s_div(s_sum('mfv', 14), s_sum('volume', 14))} AS cmf,
 CASE WHEN ({s_sum('ng', 14)}) <> 0 THEN 100 - 100 / (1 + ({s_sum('ps', 14)}) / ({s_sum('ng', 14)})) END AS mfi, {s_div(s_sum('close * volume', 14), s_sum('volume', 14))} AS vwma, (close - {s_lag('close')}) * volume AS force_index FROM (
 SELECT *, CASE WHEN tp > {s_lag('tp')} THEN tp * volume ELSE 0 END AS ps, CASE WHEN tp < {s_lag('tp')} THEN tp * volume ELSE 0 END AS ng FROM (
 SELECT *, {s_div('(close - low) - (high - close)', 'high - low', 0.0)} * volume AS mfv, (high + low + close) / 3.0 AS tp FROM bars)))""")
def _(m):
    return run(m, st.volume_flow, 16)


@query("ts12_gaps", KEY + "gap_signal:s gap_reversal:s", f"""SELECT *, {sd('open > ph', 'open < pl')} AS gap_signal, {sd('open < pl AND close > pl', 'open > ph AND close < ph')} AS gap_reversal FROM (SELECT *, {s_lag('high')} AS ph, {s_lag('low')} AS pl FROM bars)""")
def _(m):
    return run(m, st.gaps, 1)


@query("ts13_bar_patterns", KEY + "ibs inside_bar:l key_reversal:l nr7:l three_up:l engulfing:l", f"""SELECT *, {s_div('close - low', 'high - low')} AS ibs, {s_flag('high < ph AND low > pl')} AS inside_bar, {s_flag('low < pl AND close > pc')} AS key_reversal,
 {s_flag(f"r = ({s_min('r', 7)})")} AS nr7, {s_flag(f"({s_sum('u', 3)}) = 3")} AS three_up,
 CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1 WHEN close < open AND pc > po AND open >= pc AND close <= po THEN -1 ELSE 0 END AS engulfing FROM (
 SELECT *, high - low AS r, {s_flag(f"close > {s_lag('close')}")} AS u, {s_lag('high')} AS ph, {s_lag('low')} AS pl, {s_lag('close')} AS pc, {s_lag('open')} AS po FROM bars)""")
def _(m):
    return run(m, st.bar_patterns, 7)


@query("ts14_calendar_effects", KEY + "monday_long:l turn_of_month:l winter_season:l expiry_week:l", f"""SELECT *, {s_flag('isodow(d) = 1')} AS monday_long, {s_flag('day(d) <= 3 OR d = last_day(d)')} AS turn_of_month,
 {s_flag('month(d) >= 11 OR month(d) <= 4')} AS winter_season, {s_flag("abs(date_diff('day', CAST(f + ((5 - isodow(f) + 7) % 7 + 14) * INTERVAL 1 DAY AS DATE), d)) <= 4")} AS expiry_week FROM (SELECT *, CAST(ts AS DATE) AS d, CAST(date_trunc('month', ts) AS DATE) AS f FROM daily)""")
def _(m):
    return st.calendar_rules(m.daily())


_O14 = f"OVER ({S} ROWS 13 PRECEDING)"
_KERN = [2.718281828459045 ** (-0.5 * (k / 2.0) ** 2) for k in range(13, -1, -1)]
_M14, _S14 = s_mean("close", 14), s_std("close", 14)


@query("ts15_filters_regressions", KEY + "slope gaussian anomaly_z regression_signal:s", f"""SELECT *, {sd('slope > 0', 'slope < 0')} AS regression_signal FROM (SELECT *, CASE WHEN count(*) {_O14} = 14 THEN regr_slope(close, CAST(bar_idx AS DOUBLE)) {_O14} END AS slope,
 CASE WHEN count(*) {_O14} = 14 THEN list_dot_product(list(close) {_O14}, {_KERN}::DOUBLE[]) / {sum(_KERN)!r} END AS gaussian, {s_div(f'close - ({_M14})', _S14)} AS anomaly_z FROM bars)""")
def _(m):
    return run(m, st.regressions, 15)


def _mid(n):
    return f"(({s_max('high', n)}) + ({s_min('low', n)})) / 2.0"


@query("ts16_derived_levels", KEY + "pivot_point camarilla_h3 camarilla_l3 tenkan kijun typical ichimoku_signal:s", f"""SELECT *, {sd('tenkan > kijun AND close > kijun', 'tenkan < kijun AND close < kijun')} AS ichimoku_signal FROM (
 SELECT *, (ph + pl + pc) / 3.0 AS pivot_point, pc + (ph - pl) * 1.1 / 4.0 AS camarilla_h3, pc - (ph - pl) * 1.1 / 4.0 AS camarilla_l3, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, (high + low + close) / 3.0 AS typical FROM (
 SELECT *, {s_lag('high')} AS ph, {s_lag('low')} AS pl, {s_lag('close')} AS pc FROM bars))""")
def _(m):
    return run(m, st.derived_levels, 26)


@query("ts17_exits_stops", KEY + "trailing_exit:l target_exit:l stop_exit:l", f"SELECT *, {s_flag('close < hh * 0.5')} AS trailing_exit, {s_flag('close >= e * 1.5')} AS target_exit, {s_flag('close <= e * 0.5')} AS stop_exit FROM (SELECT *, {s_max('high', 20)} AS hh, {s_lag('close', 5)} AS e FROM bars)")
def _(m):
    return run(m, st.exits, 20)


_PSAR_NEXT = "r.stop + r.af * (r.ep - r.stop)"


@query("ts17_parabolic_stop", KEY + "stop trend:l", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT symbol, bar_idx, high, low, greatest({s_lag('high')}, {s_lag('high', 2)}) AS ph, least({s_lag('low')}, {s_lag('low', 2)}) AS pl FROM bars),
 r AS (SELECT symbol, bar_idx, 1 AS trend, 0.02::DOUBLE AS af, high AS ep, low AS stop FROM t WHERE bar_idx = 0 UNION ALL
 SELECT symbol, bar_idx, CASE WHEN flip THEN -trend ELSE trend END, CASE WHEN flip THEN 0.02 WHEN more THEN least(af + 0.02, 0.2) ELSE af END,
 CASE WHEN flip THEN back WHEN more THEN far ELSE ep END, CASE WHEN flip THEN ep ELSE s END FROM (
 SELECT *, trend * (back - s) < 0 AS flip, trend * (far - ep) > 0 AS more FROM (
 SELECT t.symbol, t.bar_idx, r.trend, r.af, r.ep, CASE WHEN r.trend > 0 THEN least({_PSAR_NEXT}, t.pl) ELSE greatest({_PSAR_NEXT}, t.ph) END AS s,
 CASE WHEN r.trend > 0 THEN t.high ELSE t.low END AS far, CASE WHEN r.trend > 0 THEN t.low ELSE t.high END AS back FROM r JOIN t ON t.symbol = r.symbol AND t.bar_idx = r.bar_idx + 1)))
 SELECT symbol, bar_idx, stop, trend FROM r""")
def _(m):
    lags = ["h1", "h2", "l1", "l2"]

    def run_(p, state):
        stops, sides, left = parabolic(p[["high", "low", *lags]].astype(float).to_numpy().tolist(), state)
        return {"stop": stops, "trend": sides}, left
    d = blocked(m.bars(), lambda r, w: r.withColumns({"h1": w.lag("high"), "h2": w.lag("high", 2), "l1": w.lag("low"), "l2": w.lag("low", 2)}), before=2)
    return chained(d, run_, [float("nan")] * 4, "stop double, trend int", ["high", "low", *lags])


@query("ts18_allocation_rules", KEY + "dual_momentum:s scale_in_units:l dca_buy:l", f"""SELECT *, {sd('f > 0 AND s > 0', 'f < 0 AND s < 0')} AS dual_momentum, bar_idx - {s_last('CASE WHEN l = 0 THEN bar_idx END')} AS scale_in_units,
 {s_flag('bar_idx % 24 = 0')} AS dca_buy FROM (SELECT *, close / {s_lag('close', 10)} - 1 AS f, close / {s_lag('close', 40)} - 1 AS s FROM (SELECT *, {s_flag(f"close < {s_lag('close')}")} AS l FROM bars))""")
def _(m):
    d = carry_last(run(m, st.allocation, 41), {"_held": F.when(c("losing") == 0, c("bar_idx"))})  # a losing streak may be of any length
    return d.withColumn("scale_in_units", c("bar_idx") - c("_held"))


@query("ts19_one_bar_return", KEY + "bar_return_signal:s", f"SELECT *, {sd('r > 0.5', 'r < -0.5')} AS bar_return_signal FROM (SELECT *, close / {s_lag('close')} - 1 AS r FROM bars)")
def _(m):
    return run(m, st.one_bar, 1)


_HOT = "strategy__donchian__donchian_signal__"
_FF16 = f"""SELECT *, {', '.join(f"{s_flag(f'sig = {chr(39)}{v}{chr(39)}')} AS {_HOT}{v}" for v in st.SIDES)}, {', '.join(f"{s_flag(f'gs = {chr(39)}{v}{chr(39)}')} AS strategy__gap__gap_signal__{v}" for v in st.SIDES)} FROM (
 SELECT *, {sd('high > h', 'low < l')} AS sig, {sd('open > ph', 'open < pl')} AS gs FROM (SELECT *, {s_max('high', 20, 1)} AS h, {s_min('low', 20, 1)} AS l, {s_lag('high')} AS ph, {s_lag('low')} AS pl FROM bars))"""
_FF16OUT = KEY + " ".join(f"{_HOT}{v}:l strategy__gap__gap_signal__{v}:l" for v in st.SIDES)


@query("ff16_rule_strategy_signals", _FF16OUT, _FF16)
def _(m):
    return st.run_rules(m.bars(), ["donchian", "gap"])


@query("ud02_strategy_plugin", _FF16OUT, _FF16)
def _(m):
    return st.run_rules(m.bars(), ["channel_breakout", "gap"])


@query("ud01_feature_registry", KEY + "candle_range approx_spread", "SELECT *, high - low AS candle_range, high - low AS approx_spread FROM bars")
def _(m):
    return ff.run_sets(m.bars(), ["price_action", "microstructure"])


@query("ud03_strategy_input", KEY + "Close:d Date:s Time:s", """SELECT *, close AS "Close", strftime(ny, '%Y-%m-%d') AS "Date", strftime(ny, '%H:%M:%S') AS "Time" FROM (SELECT * EXCLUDE (close), close AS close, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny FROM bars)""")
def _(m):
    t = st.title_case(m.bars())
    return t.select("symbol", "bar_idx", "Close", "Date", "Time")


@query("ud04_rolling_apply", KEY + "close_pct_rank_20", f"SELECT *, CASE WHEN count(*) {_O20} = 20 THEN (len(list_filter(list(close) {_O20}, lambda z: z < close)) + (len(list_filter(list(close) {_O20}, lambda z: z = close)) + 1) / 2.0) / 20 END AS close_pct_rank_20 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: ff.percent_rank(d, w, "close", 20), before=20)

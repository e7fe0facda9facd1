"""Labels (LB), trade metrics and threshold search (AG16-AG31, AG49-AG51), event sequences (WN24-WN31)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators import features as ff
from barloom.operators import labels as lb
from barloom.operators import metrics as mt
from barloom.operators.blocks import blocked
from barloom.operators.select import top_k
from barloom.operators.quantiles import quantiles
from barloom.plans.registry import (S, query, s_agg, s_div, s_flag, s_lag, s_last, s_lead, s_mean, s_std, shared)

KEY = "symbol:s bar_idx:l "
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

shared("ev", """SELECT symbol, bar_idx, ts, open, close, atr_14 AS atr, session_regime, CASE WHEN breakout_high_20 = 1 THEN 1 ELSE -1 END AS side,
 CASE WHEN sweep_high_20 = 1 OR sweep_low_20 = 1 THEN 'sweep' ELSE 'breakout' END AS family FROM struc JOIN sess USING (symbol, bar_idx, ts, open, close) WHERE breakout_high_20 + breakout_low_20 = 1 AND atr_14 > 0""")


def events(m):
    def build():
        d = blocked(m.bars(), lambda d, w: ff.structure(ff.volatility(d, w), w), before=61)
        d = ff.session(d).filter((c("breakout_high_20") + c("breakout_low_20") == 1) & (c("atr_14") > 0))
        fam = F.when((c("sweep_high_20") == 1) | (c("sweep_low_20") == 1), "sweep").otherwise("breakout")
        return d.select("symbol", "bar_idx", "ts", "open", "close", c("atr_14").alias("atr"), "session_regime", F.when(c("breakout_high_20") == 1, 1).otherwise(-1).alias("side"), fam.alias("family"))
    return m.stage("events", build)


def touch_sql(src, entry, target, stop, first, horizon, tp_first=True):
    a, b = ("tp", "sl") if tp_first else ("sl", "tp")
    cond = {"tp": "((e.side = 1 AND b.high >= e.target_px) OR (e.side = -1 AND b.low <= e.target_px))", "sl": "((e.side = 1 AND b.low <= e.stop_px) OR (e.side = -1 AND b.high >= e.stop_px))"}
    return f"""SELECT *, (exit_price - entry) * side AS ret, exit_idx - bar_idx AS bars_held FROM (SELECT e.*, CASE WHEN z.last_idx IS NOT NULL THEN coalesce(z.kind, 'timeout') END AS outcome, coalesce(z.hit_idx, z.last_idx) AS exit_idx,
 CASE z.kind WHEN 'tp' THEN target_px WHEN 'sl' THEN stop_px ELSE z.last_close END AS exit_price FROM (SELECT *, {entry} AS entry, {target} AS target_px, {stop} AS stop_px FROM ({src})) e LEFT JOIN (
 SELECT symbol, bar_idx, arg_min(kind, i) FILTER (kind IS NOT NULL) AS kind, min(i) FILTER (kind IS NOT NULL) AS hit_idx, max(i) AS last_idx, arg_max(cl, i) AS last_close FROM (
 SELECT e.symbol, e.bar_idx, b.bar_idx AS i, b.close AS cl, CASE WHEN {cond[a]} THEN '{a}' WHEN {cond[b]} THEN '{b}' END AS kind FROM (SELECT *, {entry} AS entry, {target} AS target_px, {stop} AS stop_px FROM ({src})) e
 JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN {first} AND {first} + {horizon - 1}) GROUP BY 1, 2) z ON z.symbol = e.symbol AND z.bar_idx = e.bar_idx)"""


LBOUT = KEY + "side:l outcome:s exit_idx:l exit_price ret bars_held:l"
shared("lb01", touch_sql("SELECT * FROM ev", "close", "close + side * 2 * atr", "close - side * atr", "e.bar_idx + 1", 23))


def labelled(m):
    return m.stage("lb01", lambda: lb.first_touch(events(m), m.bars(), c("close"), c("close") + c("side") * 2 * c("atr"), c("close") - c("side") * c("atr"), c("bar_idx") + 1, 23))


@query("lb01_triple_barrier", LBOUT, "SELECT * FROM lb01")
def _(m):
    return labelled(m)


SPECS = [("breakout", 2.5, 1.0, 30), ("sweep", 1.5, 0.75, 12)]
NEXT_SQL = f"""SELECT e.*, b.nopen, s.tp, s.sl FROM ev e JOIN (SELECT symbol, bar_idx, {s_lead('open')} AS nopen FROM bars) b USING (symbol, bar_idx) JOIN (VALUES {', '.join(f"('{a}', {b}, {d})" for a, b, d, _ in SPECS)}) s(family, tp, sl) USING (family) WHERE b.nopen IS NOT NULL"""


@query("lb02_next_open_barriers", LBOUT + " family:s entry", touch_sql(NEXT_SQL, "nopen", "nopen + side * tp * atr", "nopen - side * sl * atr", "e.bar_idx + 1", 20))
def _(m):
    nxt = blocked(m.bars(), lambda d, w: d.withColumn("nopen", w.lead("open")), before=0, after=1).select("symbol", "bar_idx", "nopen").filter("nopen is not null")
    spec = m.spark.createDataFrame([(a, b, d) for a, b, d, _ in SPECS], "family string, tp double, sl double")
    e = events(m).join(nxt, ["symbol", "bar_idx"]).join(F.broadcast(spec), "family")
    return lb.first_touch(e, m.bars(), c("nopen"), c("nopen") + c("side") * c("tp") * c("atr"), c("nopen") - c("side") * c("sl") * c("atr"), c("bar_idx") + 1, 20)


QUAL = "0.35 * CASE WHEN outcome = 'tp' THEN 1 ELSE 0 END + 0.30 * least(abs(ret) / atr / 2, 1) + 0.20 * CASE WHEN family = 'sweep' THEN 1 ELSE 0 END + 0.15 * (1 - bars_held / 24.0)"
shared("lb06", f"SELECT *, CASE WHEN quality >= 0.8 THEN 'A' WHEN quality >= 0.65 THEN 'B' WHEN quality >= 0.5 THEN 'C' ELSE 'D' END AS tier FROM (SELECT *, {QUAL} AS quality FROM lb01 WHERE outcome IS NOT NULL)")


def quality(m):
    d = labelled(m).filter("outcome is not null").withColumn("quality", F.expr(QUAL.replace("24.0", "24.0D")))
    return d.withColumn("tier", F.when(c("quality") >= 0.8, "A").when(c("quality") >= 0.65, "B").when(c("quality") >= 0.5, "C").otherwise("D"))


@query("lb06_label_quality", KEY + "quality tier:s", "SELECT * FROM lb06")
def _(m):
    return quality(m)


ZJ = "bars b JOIN lb06 e ON e.symbol = b.symbol AND b.bar_idx BETWEEN e.bar_idx - 2 AND e.bar_idx + 3 AND e.outcome = 'tp'"
shared("zone", f"SELECT b.*, coalesce(z.q, 0) AS zone_value, CASE WHEN z.symbol IS NULL THEN 0 ELSE 1 END AS in_zone FROM bars b LEFT JOIN (SELECT b.symbol, b.bar_idx, max(e.quality) AS q FROM {ZJ} GROUP BY 1, 2) z USING (symbol, bar_idx)")


def zoned(m):
    return lb.zones(quality(m).filter("outcome = 'tp'"), m.bars(), 2, 3, c("quality"))


@query("lb07_zone_labels", KEY + "in_zone:l", "SELECT * FROM zone")
def _(m):
    return zoned(m)


@query("lb08_quality_arrays", KEY + "zone_value", "SELECT * FROM zone")
def _(m):
    return zoned(m)


@query("lb09_exclusion_masks", KEY + "purged:l neg_ok:l", f"""SELECT z.symbol, z.bar_idx, CASE WHEN p.symbol IS NULL THEN 0 ELSE 1 END AS purged, CASE WHEN p.symbol IS NULL AND in_zone = 0 THEN 1 ELSE 0 END AS neg_ok FROM zone z LEFT JOIN (
 SELECT DISTINCT b.symbol, b.bar_idx FROM bars b JOIN lb06 e ON e.symbol = b.symbol AND b.bar_idx BETWEEN e.bar_idx - 5 AND e.bar_idx) p ON p.symbol = z.symbol AND p.bar_idx = z.bar_idx""")
def _(m):
    p = lb.zones(quality(m), m.bars(), 5, 0, F.lit(1.0)).select("symbol", "bar_idx", c("in_zone").alias("purged"))
    return zoned(m).join(p, ["symbol", "bar_idx"]).withColumn("neg_ok", flag((c("purged") == 0) & (c("in_zone") == 0)))


@query("lb11_target_materialisation", KEY + "long_breakout:l long_sweep:l short_breakout:l short_sweep:l", f"""SELECT b.symbol, b.bar_idx, {', '.join(f"coalesce(max(CASE WHEN e.side = {s} AND e.family = '{f}' AND e.outcome = 'tp' THEN 1 ELSE 0 END), 0) AS {n}_{f}" for s, n in ((1, 'long'), (-1, 'short')) for f in ('breakout', 'sweep'))}
 FROM bars b LEFT JOIN lb01 e ON e.symbol = b.symbol AND e.bar_idx = b.bar_idx GROUP BY 1, 2""")
def _(m):
    hot = labelled(m).filter("outcome = 'tp'").withColumn("k", F.concat(F.when(c("side") == 1, "long_").otherwise("short_"), "family"))
    names = ["long_breakout", "long_sweep", "short_breakout", "short_sweep"]
    wide = hot.groupBy("symbol", "bar_idx").pivot("k", names).agg(F.lit(1))
    return m.bars().join(wide, ["symbol", "bar_idx"], "left").fillna(0, names)


@query("lb12_event_table", "source:s symbol:s bar_idx:l side:l quality tier:s", "SELECT 'scored' AS source, symbol, bar_idx, side, quality, tier FROM lb06 UNION ALL SELECT 'raw', symbol, bar_idx, side, NULL, NULL FROM ev")
def _(m):
    a = quality(m).select("symbol", "bar_idx", "side", "quality", "tier").withColumn("source", F.lit("scored"))
    return a.unionByName(events(m).select("symbol", "bar_idx", "side").withColumn("source", F.lit("raw")), allowMissingColumns=True)


# ---- concurrency ------------------------------------------------------------------------------------------------------------
shared("conc", "SELECT b.symbol, b.bar_idx, count(e.symbol) AS concurrency FROM bars b LEFT JOIN lb01 e ON e.symbol = b.symbol AND b.bar_idx BETWEEN e.bar_idx AND e.exit_idx GROUP BY 1, 2")


def spans(m):
    return labelled(m).filter("outcome is not null").select("symbol", c("bar_idx").alias("start_idx"), c("exit_idx").alias("end_idx"), "side", "family")


def conc(m):
    return m.stage("conc", lambda: lb.concurrency(m.bars(), spans(m)).select("symbol", "bar_idx", "concurrency"))


@query("ag49_label_concurrency", KEY + "concurrency:l", "SELECT * FROM conc")
def _(m):
    return conc(m)


@query("ag50_sample_weights", KEY + "weight", "SELECT *, CASE WHEN in_zone = 1 THEN greatest(zone_value, 0.25) ELSE 1.0 END / greatest(concurrency, 1) AS weight FROM zone JOIN conc USING (symbol, bar_idx)")
def _(m):
    return zoned(m).join(conc(m), ["symbol", "bar_idx"]).withColumn("weight", lb.sample_weights(c("concurrency"), c("in_zone") == 1, c("zone_value")))


@query("ag51_average_uniqueness", "symbol:s events:l uniqueness", """SELECT symbol, count(*) AS events, avg(u) AS uniqueness FROM (SELECT e.symbol, e.bar_idx, avg(1.0 / concurrency) AS u FROM lb01 e JOIN conc ON conc.symbol = e.symbol AND conc.bar_idx BETWEEN e.bar_idx AND e.exit_idx
 WHERE e.outcome IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def _(m):
    return lb.uniqueness(spans(m), conc(m)).groupBy("symbol").agg(F.count(F.lit(1)).alias("events"), F.avg("uniqueness").alias("uniqueness"))


@query("ag53_spacing_diagnostics", "symbol:s family:s side:l events:l median_gap p90_gap median_hold", f"""SELECT symbol, family, side, count(*) AS events, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.9) AS p90_gap, quantile_cont(bars_held, 0.5) AS median_hold FROM (
 SELECT *, bar_idx - lag(bar_idx) OVER (PARTITION BY symbol, family, side ORDER BY bar_idx) AS gap FROM lb01 WHERE outcome IS NOT NULL) GROUP BY 1, 2, 3""")
def _(m):
    from barloom.operators.blocks import carry_last
    d = labelled(m).filter("outcome is not null")
    d = carry_last(d, {"_p": c("bar_idx")}, keys=("symbol", "family", "side"), strict=True).withColumn("gap", c("bar_idx") - c("_p"))
    return d.groupBy("symbol", "family", "side").agg(F.count(F.lit(1)).alias("events")).join(
        quantiles(d, ["symbol", "family", "side"], {"median_gap": (c("gap"), 0.5), "p90_gap": (c("gap"), 0.9), "median_hold": (c("bars_held"), 0.5)}), ["symbol", "family", "side"], "left")


# ---- trades -----------------------------------------------------------------------------------------------------------------
shared("trades", "SELECT *, ret AS pnl FROM lb01 WHERE outcome IS NOT NULL")


def trades(m):
    return labelled(m).filter("outcome is not null").withColumn("pnl", c("ret"))


SUMOUT = "trades:l wins:l hit_rate profit_factor expectancy total win_loss_ratio"
SUMSQL = """count(*) AS trades, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS wins, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS hit_rate, sum(pnl) FILTER (pnl > 0) / sum(-pnl) FILTER (pnl < 0) AS profit_factor, avg(pnl) AS expectancy,
 sum(pnl) AS total, avg(pnl) FILTER (pnl > 0) / avg(-pnl) FILTER (pnl < 0) AS win_loss_ratio"""


@query("ag16_period_pnl", "symbol:s period:t pnl", """SELECT s.symbol, s.period, coalesce(p.pnl, 0) AS pnl FROM (SELECT symbol, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS period FROM trades GROUP BY 1) s
 LEFT JOIN (SELECT symbol, date_trunc('day', ts) AS period, sum(pnl) AS pnl FROM trades GROUP BY 1, 2) p USING (symbol, period)""")
def _(m):
    return mt.period_pnl(trades(m), "day")


@query("ag17_buy_hold", "symbol:s period:t units", "SELECT symbol, date_trunc('week', ts) AS period, (arg_max(close, ts) - arg_min(close, ts)) / 0.1 AS units FROM bars GROUP BY 1, 2")
def _(m):
    return m.bars().groupBy("symbol", F.date_trunc("week", "ts").alias("period")).agg(((F.max_by("close", "ts") - F.min_by("close", "ts")) / 0.1).alias("units"))


@query("ag18_trade_summary", SUMOUT, f"SELECT {SUMSQL} FROM trades")
def _(m):
    return mt.summary(trades(m))


@query("ag22_group_breakdown", "family:s session_regime:s " + SUMOUT, f"SELECT family, session_regime, {SUMSQL} FROM trades GROUP BY 1, 2")
def _(m):
    return mt.summary(trades(m), ["family", "session_regime"])


EQ = f"SELECT *, equity - peak AS drawdown FROM (SELECT *, greatest(max(equity) OVER ({S} {RUN}), 0) AS peak FROM (SELECT *, sum(pnl) OVER ({S} {RUN}) AS equity FROM trades))"
shared("eq", EQ)


@query("wn26_equity_curve", KEY + "equity peak drawdown", "SELECT * FROM eq")
def _(m):
    return mt.equity(trades(m))


@query("ag19_drawdown", "symbol:s max_drawdown underwater_trades:l", "SELECT symbol, min(drawdown) AS max_drawdown, sum(CASE WHEN drawdown < -1e-9 THEN 1 ELSE 0 END) AS underwater_trades FROM eq GROUP BY 1")
def _(m):
    return mt.equity(trades(m)).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"), F.sum(flag(c("drawdown") < -1e-9)).alias("underwater_trades"))


@query("ag20_sharpe_sortino", "symbol:s periods:l sharpe sortino", """SELECT symbol, count(*) AS periods, CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(12.0) ELSE 0 END AS sharpe,
 CASE WHEN sqrt(avg(least(pnl, 0) ^ 2)) > 0 THEN avg(pnl) / sqrt(avg(least(pnl, 0) ^ 2)) * sqrt(12.0) ELSE 0 END AS sortino FROM (SELECT s.symbol, s.period, coalesce(p.pnl, 0) AS pnl FROM (
 SELECT symbol, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS period FROM trades GROUP BY 1) s LEFT JOIN (SELECT symbol, date_trunc('month', ts) AS period, sum(pnl) AS pnl FROM trades GROUP BY 1, 2) p USING (symbol, period)) GROUP BY 1""")
def _(m):
    return mt.risk_ratios(mt.period_pnl(trades(m), "month"), 12.0)


@query("ag21_pnl_concentration", "symbol:s herfindahl top_share", "SELECT symbol, sum(pnl * pnl) / (sum(abs(pnl)) * sum(abs(pnl))) AS herfindahl, max(abs(pnl)) / sum(abs(pnl)) AS top_share FROM trades GROUP BY 1")
def _(m):
    a = F.sum(F.abs("pnl"))
    return trades(m).groupBy("symbol").agg((F.sum(c("pnl") * c("pnl")) / (a * a)).alias("herfindahl"), (F.max(F.abs("pnl")) / a).alias("top_share"))


@query("ag58_confidence_quintiles", KEY + "quintile:l", "SELECT *, ntile(5) OVER (ORDER BY quality, symbol, bar_idx) AS quintile FROM lb06")
def _(m):
    from barloom.operators.select import quantile_bins
    return quantile_bins(quality(m), "quality", ["symbol", "bar_idx"], 5, "quintile")


# ---- predictions ------------------------------------------------------------------------------------------------------------
PROB = "((bar_idx * 7919 + model * 104729 + length(symbol) * 31337) % 1000) / 1000.0"
shared("pred", f"""SELECT 'm' || model AS model_id, symbol, bar_idx, ts, session_regime, {PROB} AS probability, CASE WHEN nxt > close THEN 1 ELSE 0 END AS target, nxt - close AS gain FROM (SELECT *, {s_lead('close')} AS nxt FROM sess) CROSS JOIN (VALUES (1), (2)) t(model) WHERE nxt IS NOT NULL""")


def predictions(m):
    def build():
        d = blocked(ff.session(m.bars()), lambda d, w: d.withColumn("nxt", w.lead("close")), before=0, after=1).filter("nxt is not null")
        d = d.withColumn("model", F.explode(F.array(F.lit(1), F.lit(2))))
        return d.select(F.concat(F.lit("m"), "model").alias("model_id"), "symbol", "bar_idx", "ts", "session_regime", (F.expr("(bar_idx * 7919 + model * 104729 + length(symbol) * 31337) % 1000") / 1000.0).alias("probability"),
                        flag(c("nxt") > c("close")).alias("target"), (c("nxt") - c("close")).alias("gain"))
    return m.stage("predictions", build)


def rank_sql(src, k):
    return f"""SELECT {k}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) ELSE 0 END AS average_precision, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)) ELSE 0 END AS roc_auc,
 sum(p) AS pos, sum(n) AS neg FROM (SELECT *, CAST(sum(p) OVER (PARTITION BY {k} ORDER BY probability DESC) AS DOUBLE) AS tp, CAST(sum(n) OVER (PARTITION BY {k} ORDER BY probability DESC) AS DOUBLE) AS fp FROM (SELECT {k}, probability, sum(target) AS p, sum(1 - target) AS n FROM {src} GROUP BY {k}, probability)) GROUP BY {k}"""


@query("ag26_average_precision", "model_id:s pos:l neg:l average_precision roc_auc", rank_sql("pred", "model_id"))
def _(m):
    return mt.ranking(predictions(m))


@query("ag24_regime_slices", "model_id:s session_regime:s pos:l neg:l average_precision roc_auc", rank_sql("pred", "model_id, session_regime"))
def _(m):
    return mt.ranking(predictions(m), ("model_id", "session_regime"))


@query("ag25_regime_winners", "session_regime:s winner:s runner_up:s", f"""SELECT session_regime, max(CASE WHEN rn = 1 THEN model_id END) AS winner, max(CASE WHEN rn = 2 THEN model_id END) AS runner_up FROM (
 SELECT *, row_number() OVER (PARTITION BY session_regime ORDER BY round(average_precision, 9) DESC, model_id) AS rn FROM ({rank_sql('pred', 'model_id, session_regime')})) WHERE rn <= 2 GROUP BY 1""")
def _(m):
    r = top_k(mt.ranking(predictions(m), ("model_id", "session_regime")), ["session_regime"], [F.desc(F.round("average_precision", 9)), F.asc("model_id")], 2, "rn")
    return r.groupBy("session_regime").agg(F.max(F.when(c("rn") == 1, c("model_id"))).alias("winner"), F.max(F.when(c("rn") == 2, c("model_id"))).alias("runner_up"))


GRID = [round(0.05 * k, 2) for k in range(1, 20)]
GRIDSQL = f"""SELECT *, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS fbeta, CASE WHEN emitted > 0 THEN gain / emitted ELSE 0 END AS expectancy FROM (
 SELECT *, CASE WHEN emitted > 0 THEN hits / emitted ELSE 0 END AS precision, CASE WHEN positives > 0 THEN hits / positives ELSE 0 END AS recall FROM (
 SELECT model_id, coalesce(session_regime, 'all') AS session_regime, threshold, CAST(count(*) FILTER (probability >= threshold) AS DOUBLE) AS emitted, CAST(coalesce(sum(target) FILTER (probability >= threshold), 0) AS DOUBLE) AS hits, sum(target) AS positives,
 coalesce(sum(gain) FILTER (probability >= threshold), 0) AS gain FROM pred CROSS JOIN (SELECT unnest({GRID}) AS threshold) GROUP BY GROUPING SETS ((model_id, session_regime, threshold), (model_id, threshold))))"""
shared("grid", GRIDSQL)


def grid(m):
    return mt.threshold_grid(predictions(m), GRID, [["model_id"], ["model_id", "session_regime"]])


@query("ag30_threshold_grid", "model_id:s session_regime:s threshold emitted:l hits:l positives:l precision recall fbeta expectancy", "SELECT * FROM grid")
def _(m):
    return grid(m)


@query("ag31_operating_threshold", "model_id:s session_regime:s threshold score:d4 emitted:l", """SELECT model_id, session_regime, arg_max(threshold, (round(score, 9), hits, -threshold)) AS threshold, arg_max(score, (round(score, 9), hits, -threshold)) AS score,
 arg_max(emitted, (round(score, 9), hits, -threshold)) AS emitted FROM (SELECT *, 0.6 * fbeta + 0.4 * CASE WHEN hi > lo THEN (expectancy - lo) / (hi - lo) ELSE 0 END AS score FROM (
 SELECT *, min(expectancy) OVER (PARTITION BY model_id, session_regime) AS lo, max(expectancy) OVER (PARTITION BY model_id, session_regime) AS hi FROM grid WHERE emitted >= 20)) GROUP BY 1, 2""")
def _(m):
    return mt.best_threshold(grid(m), ["model_id", "session_regime"], 20)


# ---- sequences --------------------------------------------------------------------------------------------------------------
@query("wn21_gaps_islands", KEY + "segment:l", f"SELECT *, sum(CASE WHEN d = pd THEN 0 ELSE 1 END) OVER ({S}) AS segment FROM (SELECT *, lag(d) OVER ({S}) AS pd FROM (SELECT *, close > open AS d FROM bars))")
def _(m):
    d = blocked(m.bars().withColumn("d", c("close") > c("open")), lambda d, w: d.withColumn("pd", w.lag("d")), before=1)
    return lb.islands(d, ~F.coalesce(c("d") == c("pd"), F.lit(False)), name="segment")


@query("wn24_positive_zones", "model_id:s symbol:s zone_start:l zone_end:l", """SELECT model_id, symbol, min(bar_idx) AS zone_start, max(bar_idx) AS zone_end FROM (SELECT *, bar_idx - row_number() OVER (PARTITION BY model_id, symbol ORDER BY bar_idx) AS g FROM pred WHERE target = 1) GROUP BY model_id, symbol, g""")
def _(m):
    from barloom.operators.blocks import carry_last
    p = predictions(m).filter("target = 1")
    k = ("model_id", "symbol")
    p = lb.islands(carry_last(p, {"_p": c("bar_idx")}, keys=k, strict=True), c("_p").isNull() | (c("bar_idx") - c("_p") > 1), k)
    return p.groupBy("model_id", "symbol", "island").agg(F.min("bar_idx").alias("zone_start"), F.max("bar_idx").alias("zone_end"))


COOL = """WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY model_id, symbol ORDER BY bar_idx) AS rn FROM pred WHERE probability >= 0.6),
 r AS (SELECT model_id, symbol, bar_idx, rn, bar_idx AS last FROM e WHERE rn = 1 UNION ALL SELECT e.model_id, e.symbol, e.bar_idx, e.rn, CASE WHEN e.bar_idx - r.last > 6 THEN e.bar_idx ELSE r.last END FROM r JOIN e ON e.model_id = r.model_id AND e.symbol = r.symbol AND e.rn = r.rn + 1)
 SELECT model_id, symbol, bar_idx, CASE WHEN last = bar_idx THEN 1 ELSE 0 END AS accepted FROM r"""


@query("wn25_cooldown", "model_id:s symbol:s bar_idx:l accepted:l", COOL)
def _(m):
    return lb.cooldown(predictions(m).filter("probability >= 0.6"), 6, ("model_id", "symbol"))


@query("wn27_prior_quantile_cutoff", KEY + "cutoff keep:l", f"""SELECT *, CASE WHEN quality >= cutoff THEN 1 ELSE 0 END AS keep FROM (SELECT *, CASE WHEN count(*) OVER (w) >= 10 THEN quantile_cont(quality, 0.6) OVER (w) END AS cutoff FROM
 (SELECT *, row_number() OVER ({S}) - 1 AS k FROM lb06) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))""".replace("OVER (w)", "OVER w"))
def _(m):
    from barloom.operators.blocks import number_rows
    q = number_rows(quality(m), name="k")
    from barloom.operators.blocks import Frame, spread
    d, w = spread(q, 100, idx="k"), Frame(order="k").rows(-100, -1)
    d = d.withColumn("cutoff", F.when(F.count("quality").over(w) >= 10, F.percentile("quality", 0.6).over(w))).filter("own")
    return d.withColumn("keep", flag(c("quality") >= c("cutoff")))


_FW = f"OVER ({S} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"


@query("wn28_trend_scan", KEY + "slope t_stat:d4", f"""SELECT *, slope / sqrt(greatest(syy - slope * slope * sxx, 0) / 8.0 / sxx) AS t_stat FROM (SELECT *, CASE WHEN count(*) {_FW} = 10 THEN regr_slope(lc, bi) {_FW} END AS slope, regr_sxx(lc, bi) {_FW} AS sxx, regr_syy(lc, bi) {_FW} AS syy
 FROM (SELECT *, ln(close) AS lc, CAST(bar_idx AS DOUBLE) AS bi FROM bars))""")
def _(m):
    def build(d, w):
        win = w.rows(0, 9)
        d = d.withColumns({"lc": F.log("close"), "bi": c("bar_idx").cast("double")})
        return d.withColumns({"slope": F.when(F.count("lc").over(win) == 10, F.regr_slope("lc", "bi").over(win)), "sxx": F.regr_sxx("lc", "bi").over(win), "syy": F.regr_syy("lc", "bi").over(win)})
    d = blocked(m.bars(), build, before=0, after=10)
    resid = F.greatest(c("syy") - c("slope") * c("slope") * c("sxx"), F.lit(0.0)) / 8.0
    se = F.when(c("sxx") > 0, F.sqrt(resid / F.when(c("sxx") > 0, c("sxx"))))
    return d.withColumn("t_stat", F.when(se > 0, c("slope") / F.when(se > 0, se)))


@query("wn29_lag_view", KEY + "close_lag_1 close_lag_2 close_lag_4 close_lag_8 delta_1 delta_2", f"SELECT *, {', '.join(f'{s_lag(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), k)} AS close_lag_{k}' for k in (1, 2, 4, 8))}, close - {s_lag('close')} AS delta_1, close - {s_lag('close', 2)} AS delta_2 FROM bars")
def _(m):
    return blocked(m.bars(), lambda d, w: d.withColumns({**{f"close_lag_{k}": w.lag("close", k) for k in (1, 2, 4, 8)}, "delta_1": c("close") - w.lag("close"), "delta_2": c("close") - w.lag("close", 2)}), before=8)


@query("wn30_sequence_windows", KEY + "n:l first_close last_close", f"SELECT *, len(x) AS n, x[1] AS first_close, x[len(x)] AS last_close FROM (SELECT *, list(close) OVER ({S} ROWS 15 PRECEDING) AS x FROM bars) WHERE len(x) = 16")
def _(m):
    d = blocked(m.bars(), lambda d, w: d.withColumn("x", F.collect_list(F.array("close", "volume")).over(w.rows(-15, 0))), before=15).filter(F.size("x") == 16)
    return d.withColumns({"n": F.size("x"), "first_close": c("x")[0][0], "last_close": c("x")[15][0]})


@query("wn31_near_positive", KEY + "near:l weight", f"SELECT *, CASE WHEN near = 1 AND in_zone = 0 THEN 2.0 ELSE 1.0 END AS weight FROM (SELECT *, max(in_zone) OVER ({S} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM zone)")
def _(m):
    d = blocked(zoned(m), lambda d, w: d.withColumn("near", F.max("in_zone").over(w.rows(-4, 4))), before=4, after=4)
    return d.withColumn("weight", F.when((c("near") == 1) & (c("in_zone") == 0), 2.0).otherwise(1.0))


@query("wn35_latest_revision", "user_id:l revision:l value", "SELECT user_id, max(rn) AS revision, arg_max(value, rn) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1")
def _(m):
    return m.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("revision"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("jn06_offset_self_join", KEY + "exit_close move", "SELECT e.symbol, e.bar_idx, b.close AS exit_close, (b.close - e.close) * e.side AS move FROM ev e LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 12")
def _(m):
    x = m.bars().select("symbol", (c("bar_idx") - 12).alias("bar_idx"), c("close").alias("exit_close"))
    return events(m).join(x, ["symbol", "bar_idx"], "left").withColumn("move", (c("exit_close") - c("close")) * c("side"))


@query("jn12_zone_expansion", "model_id:s symbol:s bar_idx:l event_idx:l", """SELECT p.model_id, p.symbol, p.bar_idx, z.event_idx FROM pred p LEFT JOIN (SELECT b.symbol, b.bar_idx, arg_max(e.bar_idx, (round(e.quality, 9), -e.bar_idx)) AS event_idx FROM bars b JOIN lb06 e ON e.symbol = b.symbol AND b.bar_idx BETWEEN e.bar_idx - 1 AND e.bar_idx + 4
 GROUP BY 1, 2) z ON z.symbol = p.symbol AND z.bar_idx = p.bar_idx""")
def _(m):
    from barloom.operators.relate import path
    z = path(quality(m), m.bars(), F.greatest(c("bar_idx") - 1, F.lit(0)), c("bar_idx") + 4, ())
    z = z.groupBy("symbol", "path_idx").agg(F.max_by("bar_idx", F.struct(F.round("quality", 9), -c("bar_idx"))).alias("event_idx")).withColumnRenamed("path_idx", "bar_idx")
    return predictions(m).join(z, ["symbol", "bar_idx"], "left")

"""Joins over ledgers, report tables, event metrics, dataset reports and the remaining label steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag, safe_div
from barloom.operators import calendars as cal
from barloom.operators import features as ff
from barloom.operators import labels as lb
from barloom.operators import metrics as mt
from barloom.operators import prepare as pr
from barloom.operators.blocks import blocked, carry_last, number_rows
from barloom.operators.relate import asof, path, within
from barloom.operators.select import top_k
from barloom.plans.base import DAYCLOSE, h4_swings
from barloom.plans.detect import session_eq_sql
from barloom.plans.futures import schedule
from barloom.plans.policy import costed, outcomes
from barloom.plans.registry import (S, query, s_div, s_flag, s_lag, s_last, s_mean, shared)
from barloom.operators.quantiles import quantiles
from barloom.plans.storage import SPLIT, bounds
from barloom.plans.trade import GRID, conc, events, grid, labelled, predictions, quality, trades, zoned

KEY = "symbol:s bar_idx:l "
PK = "model_id:s symbol:s bar_idx:l "


@query("jn07_prediction_to_source", PK + "split:s probability", f"SELECT p.model_id, p.symbol, b.bar_idx, b.split, p.probability FROM (SELECT model_id, symbol, probability, row_number() OVER (PARTITION BY model_id, symbol ORDER BY bar_idx) - 1 AS dev_row FROM pred) p JOIN (SELECT symbol, bar_idx, {SPLIT} AS split, row_number() OVER ({S}) - 1 AS dev_row FROM bars JOIN bounds USING (symbol)) b USING (symbol, dev_row)")
def _(m):
    d = number_rows(m.bars(), name="dev_row").join(bounds(m), "symbol").select("symbol", "bar_idx", "dev_row", F.expr(SPLIT).alias("split"))
    p = number_rows(predictions(m), keys=("model_id", "symbol"), name="dev_row").select("model_id", "symbol", "dev_row", "probability")
    return p.join(d, ["symbol", "dev_row"])


TERMS = [("C0", "2024-01-01", "2024-01-12", "CF24"), ("C0", "2024-01-12", "2024-02-01", "CG24"), ("C1", "2024-01-01", "2024-02-01", "CH24"), ("C2", "2024-01-01", "2024-02-01", "CJ24")]


@query("jn09_dated_symbology", "contract_id:s raw_symbol:s bars:l", "SELECT b.contract_id, t.s AS raw_symbol, count(*) AS bars FROM cbars b JOIN (VALUES " + ", ".join(f"('{a}', DATE '{x}', DATE '{y}', '{s}')" for a, x, y, s in TERMS) + ") t(k, a, b, s) ON t.k = b.contract_id AND CAST(b.ts AS DATE) >= t.a AND CAST(b.ts AS DATE) < t.b GROUP BY 1, 2")
def _(m):
    t = m.spark.createDataFrame(TERMS, "contract_id string, a string, b string, raw_symbol string")
    d = m.contract_bars().join(F.broadcast(t), "contract_id").filter((F.to_date("ts") >= c("a").cast("date")) & (F.to_date("ts") < c("b").cast("date")))
    one = d.withColumn("n", F.lit(1)).groupBy("symbol", "contract_id", "ts").agg(F.sum("n").alias("n"), F.max("raw_symbol").alias("raw_symbol"))
    ok = F.when(c("n") == 1, c("raw_symbol")).otherwise(F.raise_error(F.lit("symbology ranges overlap")).cast("string"))
    return one.withColumn("raw_symbol", ok).groupBy("contract_id", "raw_symbol").agg(F.count(F.lit(1)).alias("bars"))


FEED = "SELECT p.model_id, p.symbol, p.bar_idx, p.probability, b.close, CASE WHEN p.probability >= 0.6 THEN 'emit' ELSE 'hold' END AS decision, m.backend, v.side FROM pred p JOIN bars b USING (symbol, bar_idx) LEFT JOIN (VALUES ('m1', 'xgb')) m(model_id, backend) ON m.model_id = p.model_id LEFT JOIN ev v ON v.symbol = p.symbol AND v.bar_idx = p.bar_idx"


def feed(m):
    man = m.spark.createDataFrame([("m1", "xgb")], "model_id string, backend string")
    d = predictions(m).join(m.bars().select("symbol", "bar_idx", "close"), ["symbol", "bar_idx"]).join(F.broadcast(man), "model_id", "left")
    d = d.join(events(m).select("symbol", "bar_idx", "side"), ["symbol", "bar_idx"], "left")
    return d.withColumn("decision", F.when(c("probability") >= 0.6, "emit").otherwise("hold"))


@query("jn15_signal_feed", PK + "probability close decision:s backend:s side:l", f"SELECT * FROM ({FEED}) WHERE decision = 'emit' AND side IS NOT NULL ORDER BY bar_idx DESC, symbol, model_id LIMIT 40")
def _(m):
    return feed(m).filter("decision = 'emit' and side is not null").orderBy(F.desc("bar_idx"), "symbol", "model_id").limit(40)


@query("jn16_confidence_history", PK + "probability backend:s", f"SELECT model_id, symbol, bar_idx, probability, coalesce(backend, 'unknown') AS backend FROM ({FEED})")
def _(m):
    return feed(m).withColumn("backend", F.coalesce("backend", F.lit("unknown")))


@query("jn17_audit_trail", KEY + "models:s decisions:l", f"SELECT symbol, bar_idx, string_agg(model_id || '=' || decision, ',' ORDER BY model_id) AS models, count(*) AS decisions FROM ({FEED}) GROUP BY 1, 2")
def _(m):
    g = feed(m).groupBy("symbol", "bar_idx").agg(F.array_sort(F.collect_list(F.struct("model_id", "decision"))).alias("x"), F.count(F.lit(1)).alias("decisions"))
    return g.withColumn("models", F.array_join(F.transform("x", lambda r: F.concat_ws("=", r["model_id"], r["decision"])), ","))


SRC18 = f"SELECT model_id, decision, count(*) AS rows, count(side) AS with_setup FROM ({FEED}) GROUP BY 1, 2"


@query("src18_collection_export", "model_id:s decision:s rows:l with_setup:l", SRC18)
def _(m):
    from barloom.sources import files
    p = files.scratch(m.spark, "export")
    feed(m).write.partitionBy("model_id").parquet(p)
    return m.spark.read.parquet(p).groupBy("model_id", "decision").agg(F.count(F.lit(1)).alias("rows"), F.count("side").alias("with_setup"))


@query("jn18_pooled_routing", PK + "status:s", """SELECT p.model_id, p.symbol, p.bar_idx, CASE WHEN count(e.bar_idx) FILTER (e.tier <> 'D') = 1 THEN 'primary_selected' WHEN count(e.bar_idx) FILTER (e.tier <> 'D') > 1 THEN 'ambiguous_selected_setup' WHEN count(e.bar_idx) > 0 THEN 'counterfactual_only' ELSE 'no_setup' END AS status
 FROM pred p LEFT JOIN lb06 e ON e.symbol = p.symbol AND e.bar_idx BETWEEN p.bar_idx - 3 AND p.bar_idx WHERE p.probability >= 0.8 GROUP BY 1, 2, 3""")
def _(m):
    s = quality(m).select("symbol", "bar_idx", "tier")
    near = path(s, m.bars(), c("bar_idx"), c("bar_idx") + 3, ()).select("symbol", c("path_idx").alias("at"), "tier")
    g = near.groupBy("symbol", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(flag(c("tier") != "D")).alias("sel")).withColumnRenamed("at", "bar_idx")
    d = predictions(m).filter("probability >= 0.8").join(g, ["symbol", "bar_idx"], "left")
    return d.withColumn("status", F.when(c("sel") == 1, "primary_selected").when(c("sel") > 1, "ambiguous_selected_setup").when(c("n") > 0, "counterfactual_only").otherwise("no_setup"))


@query("jn19_setup_match_census", PK + "event_idx:l reasons:s role:s", """SELECT p.model_id, p.symbol, p.bar_idx, e.bar_idx AS event_idx, concat_ws(',', CASE WHEN e.tier = 'D' THEN 'low_quality' END, CASE WHEN e.family = 'sweep' THEN 'family_mismatch' END, CASE WHEN e.bar_idx > p.bar_idx THEN 'later' END) AS reasons,
 CASE WHEN e.bar_idx > p.bar_idx THEN 'later' WHEN e.tier <> 'D' AND e.family <> 'sweep' THEN 'primary' ELSE 'counterfactual' END AS role FROM pred p JOIN lb06 e ON e.symbol = p.symbol AND e.bar_idx BETWEEN p.bar_idx - 2 AND p.bar_idx + 2 WHERE p.probability >= 0.8""")
def _(m):
    s = quality(m).select("symbol", c("bar_idx").alias("event_idx"), "tier", "family")
    near = path(s, m.bars(), F.greatest(c("event_idx") - 2, F.lit(0)), c("event_idx") + 2, ()).withColumnRenamed("path_idx", "bar_idx")
    d = predictions(m).filter("probability >= 0.8").join(near, ["symbol", "bar_idx"])
    later, low, fam = c("event_idx") > c("bar_idx"), c("tier") == "D", c("family") == "sweep"
    return d.withColumns({"reasons": F.array_join(F.array_compact(F.array(F.when(low, "low_quality"), F.when(fam, "family_mismatch"), F.when(later, "later"))), ","),
                          "role": F.when(later, "later").when(~low & ~fam, "primary").otherwise("counterfactual")})


@query("jn20_model_setup_census", "model_id:s family:s rows:l status:s", "SELECT p.model_id, s.family, count(*) AS rows, o.status FROM pred p LEFT JOIN ev s ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx LEFT JOIN (" + __import__("barloom.plans.policy", fromlist=["OUT"]).OUT + ") o ON o.symbol = p.symbol AND o.bar_idx = p.bar_idx GROUP BY 1, 2, 4")
def _(m):
    d = predictions(m).join(events(m).select("symbol", "bar_idx", "family"), ["symbol", "bar_idx"], "left").join(outcomes(m).select("symbol", "bar_idx", "status"), ["symbol", "bar_idx"], "left")
    return d.groupBy("model_id", "family", "status").agg(F.count(F.lit(1)).alias("rows"))


@query("jn21_finer_bar_resolution", KEY + "both_touched:l order_known:s", """SELECT e.symbol, e.bar_idx, 1 AS both_touched, CASE WHEN f.tp_first IS NULL OR f.sl_first IS NULL OR f.tp_first = f.sl_first THEN 'adverse_first' WHEN f.tp_first < f.sl_first THEN 'target_first' ELSE 'stop_first' END AS order_known FROM bars e LEFT JOIN (
 SELECT b.symbol, b.bar_idx, min(f.ts) FILTER (f.high >= b.open + 20) AS tp_first, min(f.ts) FILTER (f.low <= b.open - 20) AS sl_first FROM bars b JOIN fine f ON f.symbol = b.symbol AND date_trunc('hour', f.ts) = b.ts GROUP BY 1, 2) f ON f.symbol = e.symbol AND f.bar_idx = e.bar_idx WHERE e.high >= e.open + 20 AND e.low <= e.open - 20""")
def _(m):
    b = m.bars().filter("high >= open + 20 and low <= open - 20").select("symbol", "bar_idx", "ts", "open")
    f = m.bars(900).select("symbol", F.date_trunc("hour", "ts").alias("ts"), c("ts").alias("fts"), c("high").alias("fh"), c("low").alias("fl"))
    g = b.join(f, ["symbol", "ts"], "left").groupBy("symbol", "bar_idx").agg(F.min(F.when(c("fh") >= c("open") + 20, c("fts"))).alias("t"), F.min(F.when(c("fl") <= c("open") - 20, c("fts"))).alias("s"))
    return g.withColumns({"both_touched": F.lit(1), "order_known": F.when(c("t") < c("s"), "target_first").when(c("t") > c("s"), "stop_first").otherwise("adverse_first")})


RTH = f"SELECT symbol, session_date, max(ts) + INTERVAL 15 MINUTE AS close_ts, max(high) AS rth_high FROM ({session_eq_sql('fine')}) WHERE is_rth GROUP BY 1, 2"


@query("jn23_latest_completed_anchor", KEY + "session_date:s rth_high", f"SELECT b.symbol, b.bar_idx, r.session_date, r.rth_high FROM bars b ASOF LEFT JOIN ({RTH}) r ON r.symbol = b.symbol AND b.ts > r.close_ts")
def _(m):
    r = cal.equity_session(m.bars(900)).filter("is_rth").groupBy("symbol", "session_date").agg(F.timestamp_seconds(F.unix_timestamp(F.max("ts")) + 900).alias("close_ts"), F.max("high").alias("rth_high"))
    return asof(m.bars(), r, "ts", "close_ts", ["session_date", "rth_high"], strict=True)


@query("jn24_rank_merge", "feature:s score", "SELECT coalesce(a.f, b.f) AS feature, (coalesce(a.s * 0.6, 0) + coalesce(b.s * 0.4, 0)) / (CASE WHEN a.s IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b.s IS NULL THEN 0 ELSE 0.4 END) AS score FROM (SELECT symbol AS f, avg(close) AS s FROM bars WHERE symbol <> 'view' GROUP BY 1) a FULL JOIN (SELECT symbol AS f, avg(volume) AS s FROM bars WHERE symbol <> 'click' GROUP BY 1) b ON a.f = b.f")
def _(m):
    b = m.bars()
    a = b.filter("symbol <> 'view'").groupBy(c("symbol").alias("feature")).agg(F.avg("close").alias("a"))
    z = b.filter("symbol <> 'click'").groupBy(c("symbol").alias("feature")).agg(F.avg("volume").alias("b"))
    d = a.join(z, "feature", "full_outer")
    num = F.coalesce(c("a") * 0.6, F.lit(0.0)) + F.coalesce(c("b") * 0.4, F.lit(0.0))
    return d.withColumn("score", num / (F.when(c("a").isNull(), 0.0).otherwise(0.6) + F.when(c("b").isNull(), 0.0).otherwise(0.4)))


@query("jn28_roll_spanning_windows", KEY + "spans_roll:l", f"""SELECT e.symbol, e.bar_idx, CASE WHEN a.seg <> z.seg THEN 1 ELSE 0 END AS spans_roll FROM lb01 e JOIN bars x ON x.symbol = e.symbol AND x.bar_idx = e.exit_idx JOIN (SELECT symbol, session_close, sum(is_roll) OVER (PARTITION BY symbol ORDER BY session_close) AS seg FROM roll) a ON a.symbol = e.symbol AND a.session_close = {DAYCLOSE.replace('ts AT', 'e.ts AT')}
 JOIN (SELECT symbol, session_close, sum(is_roll) OVER (PARTITION BY symbol ORDER BY session_close) AS seg FROM roll) z ON z.symbol = e.symbol AND z.session_close = {DAYCLOSE.replace('ts AT', 'x.ts AT')} WHERE e.outcome IS NOT NULL""")
def _(m):
    from barloom.functions import clock
    seg = schedule(m).withColumn("seg", F.sum("is_roll").over(Window.partitionBy("symbol").orderBy("session_close"))).select("symbol", "session_close", "seg")
    e = labelled(m).filter("outcome is not null").join(m.bars().select("symbol", c("bar_idx").alias("exit_idx"), c("ts").alias("xts")), ["symbol", "exit_idx"])
    e = e.withColumns({"sa": clock.day_close("ts"), "sz": clock.day_close("xts")})
    e = e.join(seg.select("symbol", c("session_close").alias("sa"), c("seg").alias("a")), ["symbol", "sa"]).join(seg.select("symbol", c("session_close").alias("sz"), c("seg").alias("z")), ["symbol", "sz"])
    return e.withColumn("spans_roll", flag(c("a") != c("z")))


# ---- reports ----------------------------------------------------------------------------------------------------------------
@query("ag13_session_open_context", "symbol:s session_date:s ib_high ib_low open_drive:l", f"""SELECT symbol, session_date, max(high) FILTER (is_ib) AS ib_high, min(low) FILTER (is_ib) AS ib_low, CASE WHEN count(*) FILTER (rn <= 3) = 3 AND (bool_and(close > pc) FILTER (rn BETWEEN 2 AND 3) OR bool_and(close < pc) FILTER (rn BETWEEN 2 AND 3)) THEN 1 ELSE 0 END AS open_drive FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts) AS rn, lag(close) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS pc FROM ({session_eq_sql('fine')}) WHERE is_rth) GROUP BY 1, 2""")
def _(m):
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    d = cal.equity_session(m.bars(900)).filter("is_rth").withColumns({"rn": F.row_number().over(w), "pc": F.lag("close").over(w)})
    early = c("rn").between(2, 3)
    g = d.groupBy("symbol", "session_date").agg(F.max(F.when(c("is_ib"), c("high"))).alias("ib_high"), F.min(F.when(c("is_ib"), c("low"))).alias("ib_low"), F.sum(flag(c("rn") <= 3)).alias("n"),
                                                F.sum(flag(early & (c("close") > c("pc")))).alias("up"), F.sum(flag(early & (c("close") < c("pc")))).alias("dn"))
    return g.withColumn("open_drive", flag((c("n") == 3) & ((c("up") == 2) | (c("dn") == 2))))


@query("ag15_profile_history", "symbol:s day:s va_width_z:d4 poc_migration:d5", """SELECT *, CASE WHEN s > 0 THEN (width - mn) / s END AS va_width_z FROM (SELECT symbol, day, vah - val AS width, poc - lag(poc) OVER w0 AS poc_migration, avg(vah - val) OVER w AS mn, stddev_samp(vah - val) OVER w AS s FROM prof WINDOW w0 AS (PARTITION BY symbol ORDER BY day), w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")
def _(m):
    from barloom.plans.futures import prof
    o = Window.partitionBy("symbol").orderBy("day")
    w = o.rowsBetween(-20, -1)
    d = prof(m).withColumn("width", c("vah") - c("val"))
    d = d.withColumns({"mn": F.avg("width").over(w), "s": F.stddev_samp("width").over(w), "poc_migration": c("poc") - F.lag("poc").over(o)})
    return d.withColumn("va_width_z", F.when(c("s") > 0, (c("width") - c("mn")) / F.when(c("s") > 0, c("s"))))


@query("ag23_walk_forward_efficiency", "symbol:s efficiency:d4 profitable_share", "SELECT symbol, avg(pnl) FILTER (bar_idx >= t1) / abs(avg(pnl) FILTER (bar_idx < t1)) AS efficiency, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (bar_idx >= t1) AS profitable_share FROM trades JOIN bounds USING (symbol) GROUP BY 1")
def _(m):
    t, tr = c("bar_idx") >= c("t1"), F.abs(F.avg(F.when(c("bar_idx") < c("t1"), c("pnl"))))
    return trades(m).join(bounds(m), "symbol").groupBy("symbol").agg((F.avg(F.when(t, c("pnl"))) / F.when(tr > 0, tr)).alias("efficiency"), F.avg(F.when(t, flag(c("pnl") > 0))).alias("profitable_share"))


@query("ag29_emitted_trade_metrics", "model_id:s trades:l gross net", "SELECT p.model_id, count(*) AS trades, avg(t.pnl) AS gross, avg(t.pnl - t.cost) AS net FROM costed t JOIN pred p ON p.symbol = t.symbol AND p.bar_idx = t.bar_idx WHERE p.probability >= 0.5 GROUP BY 1")
def _(m):
    p = predictions(m).filter("probability >= 0.5").select("symbol", "bar_idx", "model_id")
    return costed(m).join(p, ["symbol", "bar_idx"]).groupBy("model_id").agg(F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("gross"), F.avg(c("pnl") - c("cost")).alias("net"))


@query("ag35_ledger_summary", "status:s signals:l total_move", "SELECT status, count(*) AS signals, coalesce(sum(move), 0) AS total_move FROM (" + __import__("barloom.plans.policy", fromlist=["OUT"]).OUT + ") GROUP BY 1")
def _(m):
    return outcomes(m).groupBy("status").agg(F.count(F.lit(1)).alias("signals"), F.coalesce(F.sum("move"), F.lit(0.0)).alias("total_move"))


@query("ag37_policy_pair_census", "fold:s base_n:l filtered_n:l rejected_pnl", f"SELECT {SPLIT} AS fold, count(*) AS base_n, count(*) FILTER (family = 'sweep') AS filtered_n, sum(pnl) - coalesce(sum(pnl) FILTER (family = 'sweep'), 0) AS rejected_pnl FROM trades JOIN bounds USING (symbol) GROUP BY 1")
def _(m):
    s = c("family") == "sweep"
    return trades(m).join(bounds(m), "symbol").groupBy(F.expr(SPLIT).alias("fold")).agg(F.count(F.lit(1)).alias("base_n"), F.sum(flag(s)).alias("filtered_n"), (F.sum("pnl") - F.coalesce(F.sum(F.when(s, c("pnl"))), F.lit(0.0))).alias("rejected_pnl"))


@query("ag40_setup_fire_rates", "family:s side:l fires:l sessions:l per_session", "SELECT family, side, count(*) AS fires, count(DISTINCT (symbol, CAST(ts AS DATE))) AS sessions, count(*) * 1.0 / count(DISTINCT (symbol, CAST(ts AS DATE))) AS per_session FROM ev GROUP BY 1, 2")
def _(m):
    g = events(m).groupBy("family", "side", "symbol", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("family", "side").agg(F.sum("n").alias("fires"), F.count(F.lit(1)).alias("sessions"), (F.sum("n") / F.count(F.lit(1))).alias("per_session"))


@query("ag46_correlation_pruning", "left_col:s right_col:s corr", "SELECT 'atr_14' AS left_col, 'atr_50' AS right_col, corr(atr_14, atr_50) AS corr FROM vol UNION ALL SELECT 'close', 'open', corr(close, open) FROM vol UNION ALL SELECT 'candle_range', 'true_range', corr(candle_range, true_range) FROM vol")
def _(m):
    d = blocked(m.bars(), lambda d, w: ff.volatility(ff.price_action(d, w), w), before=61)
    return pr.pair_correlations(d, [("atr_14", "atr_50"), ("close", "open"), ("candle_range", "true_range")])


@query("ag47_binned_mutual_information", "feature:s mi", """SELECT 'volume' AS feature, sum(p * ln(p / (px * py))) AS mi FROM (SELECT n * 1.0 / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY b) * 1.0 / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) * 1.0 / sum(n) OVER () AS py FROM (
 SELECT len(list_filter(qs, lambda q: q < volume)) AS b, CASE WHEN close > open THEN 1 ELSE 0 END AS y, count(*) AS n FROM bars CROSS JOIN (SELECT quantile_cont(volume, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM bars) GROUP BY 1, 2))""")
def _(m):
    """Volume by deciles of the whole table; their nine bounds are one row."""
    edges = F.broadcast(quantiles(m.bars(), [], {f"q{i}": (c("volume"), i / 10) for i in range(1, 10)}))
    b = F.size(F.filter(F.array(*[c(f"q{i}") for i in range(1, 10)]), lambda q: q < c("volume")))
    return pr.mutual_information(m.bars().crossJoin(edges).withColumns({"b": b, "y": flag(c("close") > c("open"))}), "b", "y", "volume")


@query("ag48_dataset_audit", "feature:s rows:l present:l", "SELECT feature, count(*) AS rows, count(v) AS present FROM (SELECT unnest(['atr_14', 'atr_50', 'rolling_vol_60']) AS feature, unnest([atr_14, atr_50, rolling_vol_60]) AS v FROM vol) GROUP BY 1")
def _(m):
    d = blocked(m.bars(), ff.volatility, before=61)
    return d.selectExpr("stack(3, 'atr_14', atr_14, 'atr_50', atr_50, 'rolling_vol_60', rolling_vol_60) as (feature, v)").groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("present"))


@query("ag55_continuity_reports", "symbol:s rolls:l mean_step median_abs_step flagged:l", """SELECT symbol, count(*) AS rolls, avg(roll_spread) AS mean_step, any_value(med) AS median_abs_step, sum(CASE WHEN abs(roll_spread) > med + 5 * mad THEN 1 ELSE 0 END) AS flagged FROM (
 SELECT *, quantile_cont(abs(abs(roll_spread) - med), 0.5) OVER (PARTITION BY symbol) AS mad FROM (SELECT *, quantile_cont(abs(roll_spread), 0.5) OVER (PARTITION BY symbol) AS med FROM (""" + __import__("barloom.plans.futures", fromlist=["REV"]).REV + """))) GROUP BY 1""")
def _(m):
    from barloom.plans.futures import rolls
    r = rolls(m)
    r = r.join(quantiles(r, ["symbol"], {"med": (F.abs("roll_spread"), 0.5)}), "symbol").withColumn("dev", F.abs(F.abs("roll_spread") - c("med")))
    r = r.join(quantiles(r, ["symbol"], {"mad": (c("dev"), 0.5)}), "symbol")
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("rolls"), F.avg("roll_spread").alias("mean_step"), F.max("med").alias("median_abs_step"), F.sum(flag(F.abs("roll_spread") > c("med") + 5 * c("mad"))).alias("flagged"))


@query("ag56_health_summary", "symbol:s latest_bar:t latest_close predictions_24h:l", "SELECT b.symbol, max(b.ts) AS latest_bar, arg_max(b.close, b.ts) AS latest_close, any_value(p.n) AS predictions_24h FROM bars b LEFT JOIN (SELECT symbol, count(*) AS n FROM pred WHERE ts > (SELECT max(ts) FROM bars) - INTERVAL 24 HOUR GROUP BY 1) p ON p.symbol = b.symbol GROUP BY 1")
def _(m):
    now = m.bars().agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("cut"))
    p = predictions(m).join(F.broadcast(now)).filter("ts > cut").groupBy("symbol").agg(F.count(F.lit(1)).alias("predictions_24h"))
    return m.bars().groupBy("symbol").agg(F.max("ts").alias("latest_bar"), F.max_by("close", "ts").alias("latest_close")).join(p, "symbol", "left")


@query("ag60_attribution_statistics", "model_id:s mean_abs mean_signed positive_mean", "SELECT model_id, avg(abs(gain)) AS mean_abs, avg(gain) AS mean_signed, avg(gain) FILTER (target = 1) AS positive_mean FROM pred GROUP BY 1")
def _(m):
    return predictions(m).groupBy("model_id").agg(F.avg(F.abs("gain")).alias("mean_abs"), F.avg("gain").alias("mean_signed"), F.avg(F.when(c("target") == 1, c("gain"))).alias("positive_mean"))


@query("ag28_event_metrics", "model_id:s events:l zones:l hits:l", """SELECT p.model_id, count(*) AS events, (SELECT count(*) FROM (SELECT DISTINCT symbol, bar_idx - rn AS g FROM (SELECT symbol, bar_idx, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS rn FROM zone WHERE in_zone = 1))) AS zones,
 sum(z.in_zone) AS hits FROM pred p JOIN zone z ON z.symbol = p.symbol AND z.bar_idx = p.bar_idx WHERE p.probability >= 0.7 GROUP BY 1""")
def _(m):
    z = m.stage("zoned", lambda: zoned(m).select("symbol", "bar_idx", "in_zone"))
    on = carry_last(z.filter("in_zone = 1"), {"_p": c("bar_idx")}, strict=True)
    n = on.agg(F.coalesce(F.sum(flag(c("_p").isNull() | (c("bar_idx") - c("_p") > 1))), F.lit(0)).alias("zones"))
    g = predictions(m).filter("probability >= 0.7").join(z, ["symbol", "bar_idx"]).groupBy("model_id").agg(F.count(F.lit(1)).alias("events"), F.sum("in_zone").alias("hits"))
    return g.join(F.broadcast(n))


# ---- labels and models ------------------------------------------------------------------------------------------------------
@query("lb05_entry_score", KEY + "follow_through score", "SELECT e.symbol, e.bar_idx, max((CASE WHEN e.side = 1 THEN b.high - e.close ELSE e.close - b.low END) / e.atr) AS follow_through, 0.7 * least(greatest(max((CASE WHEN e.side = 1 THEN b.high - e.close ELSE e.close - b.low END) / e.atr) / 3, 0), 1) + 0.3 * least(abs(any_value(e.close) - any_value(e.open)) / any_value(e.atr), 1) AS score FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + 6 GROUP BY 1, 2")
def _(m):
    p = path(events(m), m.bars(), c("bar_idx") + 1, c("bar_idx") + 6, ("high", "low"))
    ft = F.when(c("side") == 1, c("p_high") - c("close")).otherwise(c("close") - c("p_low")) / c("atr")
    g = p.groupBy("symbol", "bar_idx").agg(F.max(ft).alias("follow_through"), F.max(F.abs(c("close") - c("open")) / c("atr")).alias("b"))
    return g.withColumn("score", 0.7 * F.least(F.greatest(c("follow_through") / 3, F.lit(0.0)), F.lit(1.0)) + 0.3 * F.least("b", F.lit(1.0)))


@query("lb10_event_exclusions", KEY + "reasons:s", f"SELECT e.symbol, e.bar_idx, concat_ws(',', CASE WHEN x.is_rth AND x.mloc < 600 THEN 'first_rth_bars' END, CASE WHEN x.hol = 1 THEN 'holiday' END, CASE WHEN e.session_regime = 'off_hours' THEN 'off_hours' END, CASE WHEN e.bar_idx < 50 THEN 'warmup' END) AS reasons FROM ev e JOIN ({session_eq_sql('bars')}) x ON x.symbol = e.symbol AND x.bar_idx = e.bar_idx")
def _(m):
    e = cal.equity_session(events(m))
    why = F.array(F.when(c("is_rth") & (c("local_minute") < 600), "first_rth_bars"), F.when(c("is_holiday"), "holiday"), F.when(c("session_regime") == "off_hours", "off_hours"), F.when(c("bar_idx") < 50, "warmup"))
    return e.withColumn("reasons", F.array_join(F.array_compact(why), ","))


@query("lb13_htf_timing", KEY + "since_htf_high:l since_htf_low:l", f"SELECT b.*, b.bar_idx - {s_last('CASE WHEN h.hi = 1 THEN b.bar_idx END', 'PARTITION BY b.symbol ORDER BY b.bar_idx')} AS since_htf_high, b.bar_idx - {s_last('CASE WHEN h.lo = 1 THEN b.bar_idx END', 'PARTITION BY b.symbol ORDER BY b.bar_idx')} AS since_htf_low FROM bars b LEFT JOIN h4swing h ON h.symbol = b.symbol AND h.ts = b.ts")
def _(m):
    b = m.stage("htf_marks", lambda: m.bars().join(h4_swings(m), ["symbol", "ts"], "left").select("symbol", "bar_idx", "hi", "lo"))
    b = carry_last(b, {"_h": F.when(c("hi") == 1, c("bar_idx")), "_l": F.when(c("lo") == 1, c("bar_idx"))})
    return b.withColumns({"since_htf_high": c("bar_idx") - c("_h"), "since_htf_low": c("bar_idx") - c("_l")})


@query("lb15_completed_publication", KEY + "known_ts:t close", "SELECT *, ts + INTERVAL 1 HOUR AS known_ts FROM bars")
def _(m):
    return m.bars().withColumn("known_ts", F.timestamp_seconds(F.unix_timestamp("ts") + 3600))


@query("ml02_categorical_encoding", KEY + "code:l", "SELECT s.symbol, s.bar_idx, coalesce(k.code, -1) AS code FROM sess s LEFT JOIN (SELECT session_regime, row_number() OVER (ORDER BY session_regime) - 1 AS code FROM (SELECT DISTINCT session_regime FROM sess JOIN bounds USING (symbol) WHERE bar_idx < t1)) k USING (session_regime)")
def _(m):
    return pr.encode(ff.session(m.bars()).join(bounds(m), "symbol"), "session_regime", c("bar_idx") < c("t1"), "code")


@query("ml04_scaling", KEY + "close_scaled", "SELECT b.symbol, b.bar_idx, (close - med) / iqr AS close_scaled FROM bars b CROSS JOIN (SELECT quantile_cont(close, 0.5) AS med, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS iqr FROM bars JOIN bounds USING (symbol) WHERE bar_idx < t1)")
def _(m):
    return pr.robust_scale(m.bars().join(bounds(m), "symbol"), ["close"], c("bar_idx") < c("t1"))


@query("ml06_purged_walk_forward", "symbol:s fold:l role:s rows:l", """SELECT b.symbol, k AS fold, CASE WHEN bar_idx < a + w * k - 24 THEN 'train' ELSE 'val' END AS role, count(*) AS rows FROM bars b
 CROSS JOIN (SELECT a, CAST(ceil((n - a) / 4.0) AS BIGINT) AS w FROM (SELECT n, CAST(floor(n * 0.3) AS BIGINT) AS a FROM (SELECT max(bar_idx) + 1 AS n FROM bars))) CROSS JOIN (VALUES (0), (1), (2), (3)) f(k)
 WHERE bar_idx < a + w * k - 24 OR (bar_idx >= a + w * k AND bar_idx < a + w * (k + 1)) GROUP BY 1, 2, 3""")
def _(m):
    return pr.walk_forward(m.bars(), 0.3, 24, 4).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("rows"))


@query("ml12_recency_weights", KEY + "weight", "SELECT b.symbol, b.bar_idx, greatest(0.2, 0.5 ^ ((mx - bar_idx) / 200.0)) AS weight FROM bars b JOIN (SELECT symbol, max(bar_idx) AS mx FROM bars GROUP BY 1) USING (symbol)")
def _(m):
    mx = m.bars().groupBy("symbol").agg(F.max("bar_idx").alias("mx"))
    return m.bars().join(mx, "symbol").withColumn("weight", F.greatest(F.lit(0.2), F.pow(F.lit(0.5), (c("mx") - c("bar_idx")) / 200.0)))


@query("ml13_threshold_sweep", "model_id:s threshold emitted:l fbeta", "SELECT * FROM grid WHERE session_regime = 'all'")
def _(m):
    return grid(m).filter("session_regime = 'all'")


@query("ml10_probability_calibration", "model_id:s bar_idx:l symbol:s calibrated")
def _(m):
    return pr.calibrate(predictions(m).join(bounds(m), "symbol"), c("bar_idx") < c("t1"))

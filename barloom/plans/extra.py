"""Anchors, setups, stateful streams, model application and the remaining report rows."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.functions.cols import c, flag, nearest, safe_div, within_count
from barloom.operators import calendars as cal
from barloom.operators import futures as fu
from barloom.operators import labels as lb
from barloom.operators import metrics as mt
from barloom.operators import prepare as pr
from barloom.operators.blocks import blocked, carry_last, kernel, number_rows
from barloom.operators.provenance import compare_summary, tolerant_compare
from barloom.operators.recursive import wilder_atr
from barloom.operators.relate import asof, path
from barloom.operators.resample import complete
from barloom.operators.quantiles import quantiles
from barloom.plans.base import DAYCLOSE, NYSQL
from barloom.plans.futures import prof, rolls, schedule, sessions
from barloom.plans.registry import (S, TR, query, s_div, s_ewm, s_flag, s_lag, s_last, s_mean, shared)
from barloom.plans.trade import COOL, GRID, SUMOUT, SUMSQL, events, grid, labelled, predictions, quality, trades

KEY = "symbol:s bar_idx:l "
PK = "model_id:s symbol:s bar_idx:l "

# ---- continuity and profile context -----------------------------------------------------------------------------------------


@query("dt20_back_adjusted_series", "symbol:s ts:t contract_id:s close adjusted", f"""SELECT b.symbol, b.ts, b.contract_id, b.close, b.close - coalesce(max(v.cumulative_spread) FILTER (v.rk = 1), 0) AS adjusted FROM (SELECT x.*, r.session_close FROM cbars x JOIN roll r ON r.symbol = x.symbol AND r.lead_contract = x.contract_id AND r.session_close = {DAYCLOSE.replace('ts AT', 'x.ts AT')}) b
 LEFT JOIN (SELECT r.symbol, r.session_close, v.cumulative_spread, 1 AS rk FROM roll r ASOF JOIN ({__import__('barloom.plans.futures', fromlist=['REV']).REV}) v ON v.symbol = r.symbol AND r.session_close >= v.session_close) v ON v.symbol = b.symbol AND v.session_close = b.session_close GROUP BY 1, 2, 3, 4""")
def _(m):
    w = Window.partitionBy("symbol").orderBy("session_close")
    adj = schedule(m).select("symbol", "session_close").join(rolls(m).select("symbol", "session_close", "cumulative_spread"), ["symbol", "session_close"], "left")
    adj = adj.withColumn("shift", F.coalesce(F.last("cumulative_spread", True).over(w), F.lit(0.0))).drop("cumulative_spread")
    d = fu.continuous(m.contract_bars(), schedule(m)).join(adj, ["symbol", "session_close"])
    return d.withColumn("adjusted", c("close") - c("shift"))


@query("dt18_completed_structural_atr", KEY + "atr_4h", f"SELECT b.symbol, b.bar_idx, h.a AS atr_4h FROM bars b ASOF LEFT JOIN (SELECT symbol, close_ts, {s_ewm('tr', 1 / 14, min_periods=14)} AS a FROM (SELECT *, {TR} AS tr FROM h4x)) h ON h.symbol = b.symbol AND b.ts >= h.close_ts")
def _(m):
    h4 = m.stage("h4", lambda: number_rows(complete(m.bars(), 14400, 3600).withColumnRenamed("bucket", "ts"), span_seconds=4096 * 14400))
    k = kernel(h4, wilder_atr(14), "satr double", ["high", "low", "close"], weeks=104)
    h = h4.join(k, ["symbol", "bar_idx"]).select("symbol", "close_ts", F.when(~F.isnan("satr"), c("satr")).alias("atr_4h"))
    return asof(m.bars(), h, "ts", "close_ts", ["atr_4h"])


@query("dt09_profile_anchors", KEY + "poc:d8 vah:d8 val:d8 shape:s", "SELECT b.symbol, b.bar_idx, p.poc, p.vah, p.val, p.shape FROM bars b ASOF LEFT JOIN (SELECT *, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS at FROM prof) p ON p.symbol = b.symbol AND b.ts >= p.at")
def _(m):
    a = prof(m).withColumn("at", F.date_add("day", 1).cast("timestamp"))
    return asof(m.bars(), a, "ts", "at", ["poc", "vah", "val", "shape"])


@query("ff19_profile_context", KEY + "dist_poc_atr:d5 in_value_area:l overlap:d5", f"""SELECT b.symbol, b.bar_idx, {s_div('b.close - p.poc', 'b.atr_14')} AS dist_poc_atr, {s_flag('b.close BETWEEN p.val AND p.vah')} AS in_value_area,
 CASE WHEN p.poc IS NULL OR p.pvah IS NULL THEN NULL WHEN least(p.vah - p.val, p.pvah - p.pval) > 0 THEN greatest(least(p.vah, p.pvah) - greatest(p.val, p.pval), 0) / least(p.vah - p.val, p.pvah - p.pval) ELSE 0 END AS overlap
 FROM vol b ASOF LEFT JOIN (SELECT *, lag(vah) OVER (PARTITION BY symbol ORDER BY day) AS pvah, lag(val) OVER (PARTITION BY symbol ORDER BY day) AS pval, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS at FROM prof) p ON p.symbol = b.symbol AND b.ts >= p.at""")
def _(m):
    from barloom.operators import features as ff
    w = Window.partitionBy("symbol").orderBy("day")
    a = prof(m).withColumns({"at": F.date_add("day", 1).cast("timestamp"), "pvah": F.lag("vah").over(w), "pval": F.lag("val").over(w)})
    d = asof(blocked(m.bars(), ff.volatility, before=61), a, "ts", "at", ["poc", "vah", "val", "pvah", "pval"])
    width = F.least(c("vah") - c("val"), c("pvah") - c("pval"))
    both = c("poc").isNotNull() & c("pvah").isNotNull()
    ov = F.when(both & (width > 0), F.greatest(F.least("vah", "pvah") - F.greatest("val", "pval"), F.lit(0.0)) / F.when(width > 0, width)).when(both, 0.0)
    return d.withColumns({"dist_poc_atr": safe_div(c("close") - c("poc"), "atr_14"), "in_value_area": flag(c("close").between(c("val"), c("vah"))), "overlap": ov})


@query("dt17_pullback_events", KEY + "side:l prior_idx:l", f"""SELECT * FROM (SELECT symbol, bar_idx, side, CASE WHEN side = 1 THEN {s_last('CASE WHEN side = -1 THEN bar_idx END', strict=True)} ELSE {s_last('CASE WHEN side = 1 THEN bar_idx END', strict=True)} END AS prior_idx FROM ev) WHERE prior_idx IS NOT NULL AND bar_idx - prior_idx BETWEEN 2 AND 48""")
def _(m):
    e = carry_last(events(m), {"_u": F.when(c("side") == 1, c("bar_idx")), "_d": F.when(c("side") == -1, c("bar_idx"))}, strict=True)
    e = e.withColumn("prior_idx", F.when(c("side") == 1, c("_d")).otherwise(c("_u")))
    return e.filter((c("bar_idx") - c("prior_idx")).between(2, 48))


# ---- labels -----------------------------------------------------------------------------------------------------------------
@query("lb04_entry_selection", KEY + "entry_idx:l entry_score", """SELECT symbol, bar_idx, arg_max(i, (round(sc, 9), -i)) AS entry_idx, max(sc) AS entry_score FROM (SELECT e.symbol, e.bar_idx, b.bar_idx AS i, 0.6 * least(greatest((e.close - b.close) * e.side / e.atr, 0), 2) / 2 + 0.4 * (1 - (b.bar_idx - e.bar_idx) / 6.0) AS sc
 FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx AND e.bar_idx + 5) GROUP BY 1, 2""")
def _(m):
    p = path(events(m), m.bars(), c("bar_idx"), c("bar_idx") + 5, ("close",))
    rr = F.least(F.greatest((c("close") - c("p_close")) * c("side") / c("atr"), F.lit(0.0)), F.lit(2.0)) / 2
    p = p.withColumn("sc", 0.6 * rr + 0.4 * (1 - c("step") / 6.0))
    return p.groupBy("symbol", "bar_idx").agg(F.max_by("path_idx", F.struct(F.round("sc", 9), -c("path_idx"))).alias("entry_idx"), F.max("sc").alias("entry_score"))


@query("lb03_structural_trailing_barriers", KEY + "status:s exit_idx:l move", None)
def _(m):
    """Target first locks a trailing stop one ATR behind the best close; the ordered path of one event is folded (at most 24 steps)."""
    p = path(events(m), m.bars(), c("bar_idx") + 1, c("bar_idx") + 24, ("high", "low", "close"))
    g = p.groupBy("symbol", "bar_idx", "side", "close", "atr").agg(F.array_sort(F.collect_list(F.struct("step", "path_idx", "p_high", "p_low", "p_close"))).alias("bars"))
    zero = F.struct(F.lit("open").alias("status"), F.lit(None).cast("long").alias("exit_idx"), F.lit(None).cast("double").alias("px"), (c("close") - c("side") * c("atr")).alias("stop"), F.lit(False).alias("trail"))
    up = c("side") == 1

    def step(s, b):
        hit_stop = F.when(up, b["p_low"] <= s["stop"]).otherwise(b["p_high"] >= s["stop"])
        target = c("close") + c("side") * 2 * c("atr")
        hit_tp = F.when(up, b["p_high"] >= target).otherwise(b["p_low"] <= target)
        done = s["status"] != "open"
        stopped = ~done & hit_stop
        on = s["trail"] | hit_tp
        moved = F.when(up, F.greatest(s["stop"], b["p_close"] - c("atr"))).otherwise(F.least(s["stop"], b["p_close"] + c("atr")))
        return F.struct(F.when(stopped, F.when(s["trail"], "trail").otherwise("stop")).otherwise(s["status"]).alias("status"), F.when(stopped, b["path_idx"]).otherwise(s["exit_idx"]).alias("exit_idx"),
                        F.when(stopped, s["stop"]).otherwise(s["px"]).alias("px"), F.when(~done & ~stopped & on, moved).otherwise(s["stop"]).alias("stop"), F.when(done | stopped, s["trail"]).otherwise(on).alias("trail"))
    out = g.withColumn("r", F.aggregate("bars", zero, step))
    last = F.element_at("bars", -1)
    return out.withColumns({"status": F.when(c("r.status") == "open", "timeout").otherwise(c("r.status")), "exit_idx": F.coalesce(c("r.exit_idx"), last["path_idx"]),
                            "move": (F.coalesce(c("r.px"), last["p_close"]) - c("close")) * c("side")})


REPLICATES = 100  #: bootstrap replicates


# ---- reports ----------------------------------------------------------------------------------------------------------------
@query("ag27_bootstrap_interval", "model_id:s low high")
def _(m):
    """Poisson(1) weights from a hash per replicate; scores are counted per step first, so replicates multiply steps."""
    p = predictions(m).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    u = F.pmod(F.xxhash64("model_id", "symbol", "bar_idx", "b"), F.lit(1 << 40)) / float(1 << 40)
    below, w, term = 0.0, F.lit(0), math.exp(-1)
    for k in range(16):  # weight k + 1 and more beyond the sum of the first terms; 16 terms leave less than a step of u
        below += term / math.factorial(k)
        w = w + F.when(u >= below, 1).otherwise(0)
    g = p.withColumn("w", w).groupBy("model_id", "b", "probability").agg(F.sum(c("w") * c("target")).alias("p"), F.sum("w").alias("n"))
    from barloom.operators.blocks import running
    r = running(mt.by_score(g, ("model_id", "b")), sums={"tp": c("p"), "all": c("n")}, keys=("model_id", "b"), order="_o")
    ap = r.groupBy("model_id", "b").agg((F.sum(F.when(c("all") > 0, c("p") * c("tp") / F.when(c("all") > 0, c("all")))) / F.sum("p")).alias("ap"))
    return ap.groupBy("model_id").agg(F.percentile("ap", 0.025).alias("low"), F.percentile("ap", 0.975).alias("high"))


VAR = "SELECT model_id, 'global' AS variant, * EXCLUDE (model_id) FROM pred WHERE probability >= 0.5 UNION ALL SELECT model_id, 'regime', * EXCLUDE (model_id) FROM pred WHERE probability >= CASE session_regime WHEN 'london' THEN 0.6 WHEN 'overlap' THEN 0.4 ELSE 0.5 END UNION ALL SELECT model_id, 'abstain', * EXCLUDE (model_id) FROM pred WHERE probability >= 0.5 AND session_regime <> 'off_hours'"
VARQ = f"SELECT model_id, variant, count(*) AS emitted, avg(CAST(target AS DOUBLE)) AS precision, avg(gain) AS expectancy FROM ({VAR}) GROUP BY 1, 2"


def variants(m):
    p = predictions(m)
    thr = F.when(c("session_regime") == "london", 0.6).when(c("session_regime") == "overlap", 0.4).otherwise(0.5)
    v = F.array_compact(F.array(F.when(c("probability") >= 0.5, "global"), F.when(c("probability") >= thr, "regime"), F.when((c("probability") >= 0.5) & (c("session_regime") != "off_hours"), "abstain")))
    return p.withColumn("variant", F.explode(v)).groupBy("model_id", "variant").agg(F.count(F.lit(1)).alias("emitted"), F.avg("target").alias("precision"), F.avg("gain").alias("expectancy"))


@query("ag32_policy_variants", "model_id:s variant:s emitted:l precision expectancy", VARQ)
def _(m):
    return variants(m)


@query("ag33_policy_selection", "model_id:s variant:s passed:l", f"SELECT v.model_id, v.variant, CASE WHEN v.emitted >= 0.5 * b.emitted AND v.expectancy >= b.expectancy AND v.precision >= 0.4 THEN 1 ELSE 0 END AS passed FROM ({VARQ}) v JOIN ({VARQ}) b ON b.model_id = v.model_id AND b.variant = 'global'")
def _(m):
    v = variants(m)
    b = v.filter("variant = 'global'").select("model_id", c("emitted").alias("be"), c("expectancy").alias("bx"))
    d = v.join(b, "model_id")
    return d.withColumn("passed", flag((c("emitted") >= 0.5 * c("be")) & (c("expectancy") >= c("bx")) & (c("precision") >= 0.4)))


PARITY = "SELECT feature, count(*) FILTER (b IS NOT NULL) AS compared, count(*) FILTER (abs(a - b) <= 1e-6) AS matched, max(abs(a - b)) AS max_abs_diff FROM (SELECT unnest(['close', 'volume']) AS feature, unnest([x.close, x.volume]) AS a, unnest([CASE WHEN x.bar_idx % 31 = 0 THEN x.close + 0.25 ELSE x.close END, x.volume]) AS b FROM bars x) GROUP BY 1"


def parity(m):
    b = m.bars()
    other = b.withColumn("close", F.when(c("bar_idx") % 31 == 0, c("close") + 0.25).otherwise(c("close")))
    return compare_summary(tolerant_compare(b, other, ["symbol", "bar_idx"], ["close", "volume"], 1e-6, 0.0))


@query("ag59_parity_summary", "feature:s compared:l matched:l max_abs_diff", PARITY)
def _(m):
    return parity(m)


@query("outcome19_audit_replay", "feature:s compared:l matched:l max_abs_diff", PARITY)
def _(m):
    return parity(m)


@query("ag62_lineage_closure", "child:l ancestors:l", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS child, o_custkey // 3 AS parent FROM orders WHERE o_custkey > 0), r AS (SELECT child, parent FROM e UNION SELECT r.child, r.parent // 3 FROM r WHERE r.parent > 0) SELECT child, count(*) AS ancestors FROM r GROUP BY 1""")
def _(m):
    """Transitive closure by doubling: each round joins the closure with itself until no pair is new, so the rounds grow with the log of the depth."""
    def until_stable(name, rows, grow):
        n, k = -1, 0
        while True:
            rows = m.stage(f"{name}{k}", lambda rows=rows: grow(rows) if k else rows)
            if (now := rows.count()) == n:
                return rows
            n, k = now, k + 1

    e = m.table("orders").filter("o_custkey > 0").select(c("o_custkey").alias("child"), F.floor(c("o_custkey") / 3).alias("parent")).distinct()
    # every ancestor is itself an edge source
    up = until_stable("lineage", e.select(c("parent").alias("child")).distinct().filter("child > 0"),
                      lambda u: u.unionByName(u.select(F.floor(c("child") / 3).alias("child")).filter("child > 0")).distinct())
    edges = e.unionByName(up.withColumn("parent", F.floor(c("child") / 3))).distinct()
    clo = until_stable("closure", edges, lambda r: r.unionByName(r.join(r.select(c("child").alias("parent"), c("parent").alias("up")), "parent").select("child", c("up").alias("parent"))).distinct())
    return clo.join(e.select("child"), "child", "left_semi").groupBy("child").agg(F.count(F.lit(1)).alias("ancestors"))


@query("ag63_portfolio_floor", "family:s trades:l total", "SELECT family, count(*) AS trades, sum(pnl) AS total FROM (SELECT t.* FROM trades t JOIN pred p ON p.symbol = t.symbol AND p.bar_idx = t.bar_idx WHERE p.probability >= 0.3 QUALIFY row_number() OVER (PARTITION BY t.symbol, t.side, t.family, t.bar_idx ORDER BY p.model_id) = 1) GROUP BY 1")
def _(m):
    p = predictions(m).filter("probability >= 0.3").groupBy("symbol", "bar_idx").agg(F.min("model_id").alias("model_id"))
    return trades(m).join(p, ["symbol", "bar_idx"]).groupBy("family").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total"))


# ---- policies and streams ---------------------------------------------------------------------------------------------------
@query("outcome07_route_resolution", "family:s side:l route:s rows:l", "SELECT family, side, CASE WHEN family = 'breakout' AND side = 1 THEN 'trend_long' WHEN family = 'sweep' THEN 'reversal' END AS route, count(*) AS rows FROM ev GROUP BY 1, 2, 3")
def _(m):
    b = m.spark.createDataFrame([("breakout", 1, "trend_long"), ("sweep", 1, "reversal"), ("sweep", -1, "reversal")], "family string, side int, route string")
    return events(m).groupBy("family", "side").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(b), ["family", "side"], "left")


@query("outcome12_walk_forward_backtest", "fold:l model_id:s threshold emitted:l gain", f"""WITH z AS (SELECT k, a + w * k AS s, a + w * (k + 1) AS e FROM (SELECT a, CAST(ceil((n - a) / 3.0) AS BIGINT) AS w FROM (
 SELECT n, CAST(floor(n * 0.4) AS BIGINT) AS a FROM (SELECT max(bar_idx) + 1 AS n FROM pred))) CROSS JOIN (VALUES (0), (1), (2)) f(k))
 SELECT z.k AS fold, t.model_id, t.threshold, count(*) FILTER (p.probability >= t.threshold) AS emitted, coalesce(sum(p.gain) FILTER (p.probability >= t.threshold), 0) AS gain FROM z JOIN (
 SELECT k, model_id, arg_max(threshold, (round(e, 9), -threshold)) AS threshold FROM (SELECT z.k, model_id, threshold, avg(gain) FILTER (probability >= threshold) AS e, count(*) FILTER (probability >= threshold) AS n FROM pred CROSS JOIN z CROSS JOIN (SELECT unnest({GRID}) AS threshold) WHERE bar_idx < z.s - 24 GROUP BY 1, 2, 3) WHERE n >= 20 GROUP BY 1, 2) t ON t.k = z.k
 JOIN pred p ON p.model_id = t.model_id AND p.bar_idx >= z.s AND p.bar_idx < z.e GROUP BY 1, 2, 3""")
def _(m):
    f = pr.walk_forward(predictions(m), 0.4, 24, 3)
    tr = mt.threshold_grid(f.filter("role = 'train'"), GRID, [["fold", "model_id"]]).filter("emitted >= 20")
    best = tr.groupBy(c("fold").cast("int").alias("fold"), "model_id").agg(F.max_by("threshold", F.struct(F.round("expectancy", 9), -c("threshold"))).alias("threshold"))
    te = f.filter("role = 'val'").join(best, ["fold", "model_id"])
    on = c("probability") >= c("threshold")
    return te.groupBy("fold", "model_id", "threshold").agg(F.sum(flag(on)).alias("emitted"), F.sum(F.when(on, c("gain")).otherwise(0.0)).alias("gain"))


@query("outcome15_paper_ledger", KEY + "settle_idx:l net", "SELECT e.symbol, e.bar_idx, b.bar_idx AS settle_idx, (b.close - e.close) * e.side - 0.5 AS net FROM ev e LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 20")
def _(m):
    b = m.bars().select("symbol", c("bar_idx").alias("settle_idx"), (c("bar_idx") - 20).alias("bar_idx"), c("close").alias("px"))
    return events(m).join(b, ["symbol", "bar_idx"], "left").withColumn("net", (c("px") - c("close")) * c("side") - 0.5)


@query("outcome16_setup_history", KEY + "change:s", "SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.bar_idx, o.bar_idx) AS bar_idx, CASE WHEN o.symbol IS NULL THEN 'observed' WHEN n.symbol IS NULL THEN 'invalidated' WHEN n.tier <> o.tier THEN 'revised' ELSE 'unchanged' END AS change FROM (SELECT symbol, bar_idx, CASE WHEN bar_idx % 5 = 0 THEN 'A' ELSE tier END AS tier FROM lb06 WHERE bar_idx % 7 <> 0) n FULL JOIN (SELECT symbol, bar_idx, tier FROM lb06 WHERE bar_idx % 3 <> 0) o ON o.symbol = n.symbol AND o.bar_idx = n.bar_idx")
def _(m):
    q = quality(m).select("symbol", "bar_idx", "tier")
    new = q.filter("bar_idx % 7 <> 0").select("symbol", "bar_idx", F.sha2(F.when(c("bar_idx") % 5 == 0, "A").otherwise(c("tier")), 256).alias("n"))
    old = q.filter("bar_idx % 3 <> 0").select("symbol", "bar_idx", F.sha2("tier", 256).alias("o"))
    d = new.join(old, ["symbol", "bar_idx"], "full_outer")
    return d.withColumn("change", F.when(c("o").isNull(), "observed").when(c("n").isNull(), "invalidated").when(c("n") != c("o"), "revised").otherwise("unchanged"))


@query("outcome18_setup_links", PK, "SELECT p.model_id, p.symbol, p.bar_idx FROM pred p JOIN ev e ON e.symbol = p.symbol AND e.bar_idx = p.bar_idx WHERE NOT (p.bar_idx % 4 = 0)")
def _(m):
    d = predictions(m).join(events(m).select("symbol", "bar_idx"), ["symbol", "bar_idx"])
    have = d.filter("bar_idx % 4 = 0").select("model_id", "symbol", "bar_idx")
    return d.join(have, ["model_id", "symbol", "bar_idx"], "left_anti")


@query("sm07_stateful_decisions", PK + "accepted:l", COOL)
def _(m):
    from barloom.streaming.decide import decision_stream
    return decision_stream(m, predictions(m).filter("probability >= 0.6").select("model_id", "symbol", "bar_idx"), 6)


@query("outcome09_live_decision", PK + "accepted:l", COOL)
def _(m):
    from barloom.streaming.decide import decision_stream
    return decision_stream(m, predictions(m).filter("probability >= 0.6").select("model_id", "symbol", "bar_idx"), 6)


@query("ml11_batch_scoring", KEY + "score", f"SELECT symbol, bar_idx, 1 / (1 + exp(-(0.3 * coalesce(close_return_1, 0) - 0.2 * coalesce(body_to_range, 0)))) AS score FROM pa")
def _(m):
    from barloom.operators import features as ff
    d = blocked(m.bars(), ff.price_action, before=10)
    z = 0.3 * F.coalesce("close_return_1", F.lit(0.0)) - 0.2 * F.coalesce("body_to_range", F.lit(0.0))
    return d.withColumn("score", 1 / (1 + F.exp(-z)))


# ---- audits and settlement ----------------------------------------------------------------------------------------------------
@query("ag41_label_outcome_diagnostics", "family:s side:l year:l events:l labelled:l base_rate stopped:l timed_out:l excluded:l events_per_day", """SELECT family, side, year(ts) AS year, count(*) AS events, count(outcome) AS labelled,
 avg(CASE WHEN outcome = 'tp' THEN 1.0 WHEN outcome IS NOT NULL THEN 0.0 END) AS base_rate, count(*) FILTER (outcome = 'sl') AS stopped, count(*) FILTER (outcome IS NOT NULL AND outcome NOT IN ('tp', 'sl')) AS timed_out,
 count(*) - count(outcome) AS excluded, count(*) / CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS events_per_day FROM lb01 GROUP BY 1, 2, 3""")
def _(m):
    """Events, base rate and reasons per family, side and year; an event without a complete path is excluded."""
    o = c("outcome")
    count = lambda cond: F.count(F.when(cond, 1))
    return labelled(m).groupBy("family", "side", F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("events"), F.count("outcome").alias("labelled"), F.avg(F.when(o == "tp", 1.0).when(o.isNotNull(), 0.0)).alias("base_rate"), count(o == "sl").alias("stopped"),
        count(o.isNotNull() & ~o.isin("tp", "sl")).alias("timed_out"), count(o.isNull()).alias("excluded"), (F.count(F.lit(1)) / F.countDistinct(F.to_date("ts"))).alias("events_per_day"))


@query("ag54_event_geometry_audit", "family:s session_regime:s events:l stop_median stop_p90 hold_median hold_max:l overlapping:l", f"""SELECT family, session_regime, count(*) AS events, quantile_cont(atr / close, 0.5) AS stop_median, quantile_cont(atr / close, 0.9) AS stop_p90,
 quantile_cont(exit_idx - bar_idx, 0.5) AS hold_median, max(exit_idx - bar_idx) AS hold_max, sum(CASE WHEN before >= bar_idx THEN 1 ELSE 0 END) AS overlapping FROM (
 SELECT *, max(exit_idx) OVER (PARTITION BY symbol, family ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lb01 WHERE outcome IS NOT NULL) GROUP BY 1, 2""")
def _(m):
    """Barrier distances, holding times and events that open inside an earlier event of their family; the furthest exit so far is a block scan."""
    from barloom.operators.blocks import running
    d = running(labelled(m).filter("outcome is not null"), maxs={"_far": c("exit_idx")}, keys=("symbol", "family"))
    d = carry_last(d, {"_before": c("_far")}, keys=("symbol", "family"), strict=True)
    hold, stop = c("exit_idx") - c("bar_idx"), c("atr") / c("close")
    return d.groupBy("family", "session_regime").agg(
        F.count(F.lit(1)).alias("events"), F.max(hold).alias("hold_max"), F.sum(flag(c("_before") >= c("bar_idx"))).alias("overlapping")).join(
        quantiles(d, ["family", "session_regime"], {"stop_median": (stop, 0.5), "stop_p90": (stop, 0.9), "hold_median": (hold, 0.5)}), ["family", "session_regime"], "left")


@query("sm08_settle_on_later_bar", KEY + "side:l settle_idx:l move", "SELECT e.symbol, e.bar_idx, e.side, b.bar_idx AS settle_idx, (b.close - e.close) * e.side AS move FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 20")
def _(m):
    from barloom.streaming.decide import settle_stream
    return settle_stream(m, events(m).select("symbol", "bar_idx", "ts", "side", "close"), m.bars().select("symbol", "bar_idx", "ts", "close"), 20)

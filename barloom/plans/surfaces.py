"""OP06: one table over ledgers, signal variants and cost cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators import labels as lb
from barloom.plans.policy import costed
from barloom.plans.registry import QUERIES, query

VARIANTS = {"all": "true", "sweep": "family = 'sweep'", "breakout": "family = 'breakout'", "long": "side = 1", "short": "side = -1"}
COSTS = {"none": 0.0, "base": 1.0, "stressed": 2.0}
_V = " UNION ALL ".join(f"SELECT *, '{n}' AS variant FROM {{src}} WHERE {k}" for n, k in VARIANTS.items())
_SUMS = "count(*) AS signals, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS hit_rate, avg(net) AS mean_net, sum(net) AS total_net, min(net) AS worst"
SQL = f"""WITH RECURSIVE v AS MATERIALIZED ({_V.format(src='costed')}), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY variant, symbol ORDER BY bar_idx) AS rn FROM v),
 r AS (SELECT variant, symbol, rn, exit_idx AS free, true AS took FROM e WHERE rn = 1 UNION ALL SELECT e.variant, e.symbol, e.rn, CASE WHEN e.bar_idx > r.free THEN e.exit_idx ELSE r.free END, e.bar_idx > r.free FROM r JOIN e ON e.variant = r.variant AND e.symbol = r.symbol AND e.rn = r.rn + 1),
 l AS (SELECT 'independent' AS ledger, variant, 0 AS h, pnl, cost FROM v UNION ALL SELECT 'capacity', e.variant, 0, e.pnl, e.cost FROM e JOIN r ON r.variant = e.variant AND r.symbol = e.symbol AND r.rn = e.rn WHERE r.took
 UNION ALL SELECT 'markout', o.variant, o.h, o.move, 0.0 FROM ({_V.format(src=f"(SELECT o.*, x.family, x.side FROM ({QUERIES['outcome02_forward_response'].sql}) o JOIN ev x ON x.symbol = o.symbol AND x.bar_idx = o.bar_idx WHERE o.status = 'COMPLETE')")}) o)
 SELECT ledger, variant, cost_case, h, {_SUMS} FROM (SELECT l.*, k.cost_case, pnl - k.m * cost AS net FROM l CROSS JOIN (VALUES {', '.join(f"('{n}', {x}::DOUBLE)" for n, x in COSTS.items())}) k(cost_case, m)) GROUP BY 1, 2, 3, 4"""


@query("outcome06_stream_surfaces", "ledger:s variant:s cost_case:s h:l signals:l hit_rate mean_net total_net worst", SQL)
def _(m):
    """Markouts of complete horizons, every trade on its own, and one open position a symbol; each for all variants and cost cases."""
    from barloom.plans.trade import events
    which = F.array_compact(F.array(*[F.when(F.expr(k), F.lit(n)) for n, k in VARIANTS.items()]))
    t = m.stage("variant_trades", lambda: costed(m).select("symbol", "bar_idx", "exit_idx", "side", "family", "pnl", "cost").withColumn("variant", F.explode(which)))
    cut = lambda d, name, h=F.lit(0): d.select(F.lit(name).alias("ledger"), "variant", h.cast("long").alias("h"), "pnl", "cost")
    marks = QUERIES["outcome02_forward_response"].build(m).filter("status = 'COMPLETE'").select("symbol", "bar_idx", "h", c("move").alias("pnl"))
    marks = marks.join(events(m).select("symbol", "bar_idx", "side", "family"), ["symbol", "bar_idx"]).withColumns({"variant": F.explode(which), "cost": F.lit(0.0)})
    every = cut(t, "independent").unionByName(cut(lb.admit(t, ("variant", "symbol")).filter("admitted = 1"), "capacity")).unionByName(cut(marks, "markout", c("h")))
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("cost_case"), F.lit(x).alias("m")) for n, x in COSTS.items()]))
    every = every.withColumn("k", cases).withColumns({"cost_case": c("k.cost_case"), "net": c("pnl") - c("k.m") * c("cost")})
    return every.groupBy("ledger", "variant", "cost_case", "h").agg(F.count(F.lit(1)).alias("signals"), F.avg(F.when(c("net") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("net").alias("mean_net"), F.sum("net").alias("total_net"), F.min("net").alias("worst"))

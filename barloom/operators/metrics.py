"""Trade performance, ranking quality and threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators.blocks import carry_last, chained, positions, running
from barloom.store import saved


def summary(trades: DataFrame, by=()) -> DataFrame:
    """Counts, hit rate, profit factor, expectancy and win/loss ratio; one aggregate, null groups kept."""
    win, loss = F.sum(F.when(c("pnl") > 0, c("pnl"))), F.sum(F.when(c("pnl") < 0, -c("pnl")))
    aw, al = F.avg(F.when(c("pnl") > 0, c("pnl"))), F.avg(F.when(c("pnl") < 0, -c("pnl")))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(flag(c("pnl") > 0)).alias("wins"), F.avg(flag(c("pnl") > 0)).alias("hit_rate"),
        (win / loss).alias("profit_factor"), F.avg("pnl").alias("expectancy"), F.sum("pnl").alias("total"), (aw / al).alias("win_loss_ratio"))


def equity(trades: DataFrame, keys=("symbol",), order: str = "bar_idx") -> DataFrame:
    """Cumulative P&L, running peak (from 0) and drawdown."""
    e = running(trades, sums={"equity": c("pnl")}, keys=keys, order=order)
    e = running(e, maxs={"_pk": c("equity")}, keys=keys, order=order)
    e = e.withColumn("peak", F.greatest("_pk", F.lit(0.0))).drop("_pk")
    return e.withColumn("drawdown", c("equity") - c("peak"))


def period_pnl(trades: DataFrame, unit: str, keys=("symbol",)) -> DataFrame:
    """Sum per calendar period over the whole range, empty periods as zero."""
    p = trades.groupBy(*keys, F.date_trunc(unit, "ts").alias("period")).agg(F.sum("pnl").alias("pnl"))
    ends = p.groupBy(*keys).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS"}[unit]
    full = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(step))).alias("period"))
    return full.join(p, [*keys, "period"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def risk_ratios(periods: DataFrame, per_year: float, keys=("symbol",)) -> DataFrame:
    """Annualised Sharpe and Sortino over period P&L with population deviations."""
    down = F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), F.lit(2.0))))
    g = periods.groupBy(*keys).agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"), down.alias("d"), F.count(F.lit(1)).alias("periods"))
    root = per_year ** 0.5
    return g.withColumns({"sharpe": F.when(c("s") > 0, c("m") / c("s") * root).otherwise(0.0), "sortino": F.when(c("d") > 0, c("m") / c("d") * root).otherwise(0.0)})


def by_score(g: DataFrame, keys, scale: int = 1_000_000) -> DataFrame:
    """Position ``_o`` of each distinct score, highest first; scores are compared in full, ``scale`` only sets the width of the chunks they are ranked in."""
    return positions(g, [F.desc("probability")], F.floor(-c("probability") * scale), keys, "_o")


def ranking(scored: DataFrame, keys=("model_id",), scale: int = 1_000_000, size: int = 4096) -> DataFrame:
    """Step-wise average precision and ROC AUC with tied scores grouped; 0 when only one class is present.

    Scores are first collapsed to distinct values, then prefix-summed block by block from the highest down.
    """
    g = scored.groupBy(*keys, "probability").agg(F.sum("target").alias("p"), F.sum(1 - c("target")).alias("n"))
    r = running(by_score(g, keys, scale), sums={"tp": c("p"), "fp": c("n")}, keys=keys, order="_o", size=size)
    out = r.groupBy(*keys).agg(F.sum(c("p") * c("tp") / (c("tp") + c("fp"))).alias("a"), F.sum("p").alias("pos"), F.sum("n").alias("neg"),
                               F.sum(c("n") * (c("tp") - c("p") / 2.0)).alias("area"))
    both = (c("pos") > 0) & (c("neg") > 0)
    return out.withColumns({"average_precision": F.when(both, c("a") / c("pos")).otherwise(0.0), "roc_auc": F.when(both, c("area") / (c("pos") * c("neg"))).otherwise(0.0)})


def fbeta(precision, recall, beta: float = 0.5):
    b = beta * beta
    den = b * precision + recall
    return F.when(den > 0, (1 + b) * precision * recall / den).otherwise(0.0)


def threshold_grid(scored: DataFrame, grid: list[float], by: list[list[str]]) -> DataFrame:
    """Every threshold for every grouping at once. Rows are counted per score step first, so the grid multiplies steps, not rows."""
    steps = sorted(grid)
    level = sum((flag(c("probability") >= t) for t in steps), F.lit(0))
    cols = sorted({x for g in by for x in g})
    cells = scored.withColumn("_lv", level).groupBy(*cols, "_lv").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("p"), F.sum("gain").alias("g"))
    wide = cells.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("need")) for i, t in enumerate(steps)])).alias("_t"))
    on = c("_lv") >= c("_t.need")
    parts = []
    for g in by:
        parts.append(wide.groupBy(*g, c("_t.threshold").alias("threshold")).agg(
            F.sum(F.when(on, c("n")).otherwise(0)).alias("emitted"), F.sum(F.when(on, c("p")).otherwise(0)).alias("hits"), F.sum("p").alias("positives"),
            F.sum(F.when(on, c("g")).otherwise(0.0)).alias("gain")).select(*[c(x) if x in g else F.lit("all").alias(x) for x in cols], "threshold", "emitted", "hits", "positives", "gain"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    prec, rec = F.when(c("emitted") > 0, c("hits") / c("emitted")).otherwise(0.0), F.when(c("positives") > 0, c("hits") / c("positives")).otherwise(0.0)
    out = out.withColumns({"precision": prec, "recall": rec})
    return out.withColumns({"fbeta": fbeta(c("precision"), c("recall")), "expectancy": F.when(c("emitted") > 0, c("gain") / c("emitted")).otherwise(0.0)})


def best_threshold(grid: DataFrame, keys: list[str], min_emitted: int = 1) -> DataFrame:
    """0.6 F-beta + 0.4 expectancy scaled within the key; ties to more hits, then the lower threshold."""
    g = grid.filter(c("emitted") >= min_emitted)
    w = Window.partitionBy(*keys)
    lo, hi = F.min("expectancy").over(w), F.max("expectancy").over(w)
    g = g.withColumn("score", 0.6 * c("fbeta") + 0.4 * F.when(hi > lo, (c("expectancy") - lo) / (hi - lo)).otherwise(0.0))
    pick = F.max_by(F.struct("threshold", "score", "emitted", "hits"), F.struct(F.round("score", 9), "hits", -c("threshold")))
    return g.groupBy(*keys).agg(pick.alias("b")).select(*keys, "b.*")


def positive_zones(scored: DataFrame, keys: tuple[str, ...], label: str = "target", idx: str = "bar_idx") -> DataFrame:
    """(keys, zone, start, end): runs of neighbouring positions whose label is 1, numbered from 1 in order."""
    on = carry_last(scored.filter(c(label) == 1).select(*keys, idx), {"_p": c(idx)}, keys=keys, order=idx, strict=True)
    on = running(on, sums={"zone": flag(c("_p").isNull() | (c(idx) != c("_p") + 1))}, keys=keys, order=idx)
    return on.groupBy(*keys, "zone").agg(F.min(idx).alias("start"), F.max(idx).alias("end"))


def _match(p, state):
    """Each event takes the first free zone it may match; zones before the last one taken are taken or too early for good."""
    last, out = state[0], []
    for lo, hi in zip(p["_lo"].tolist(), p["_hi"].tolist()):
        take = max(lo, last + 1)
        out.append(int(take <= hi))
        last = take if out[-1] else last
    return {"matched": out}, [last]


def matched_events(events: DataFrame, zones: DataFrame, keys: tuple[str, ...], tolerance: int, idx: str = "bar_idx") -> DataFrame:
    """``events`` with matched (1 or 0): one-to-one, in order of position, to zones within ``tolerance`` positions of either end.

    Zones are disjoint and ordered, so what an event may match is a range of zone numbers; the walk only keeps the last zone taken.
    """
    def upto(edge, after: int, name: str) -> DataFrame:
        line = events.select(*keys, idx, (c(idx) * 2 + 1 - after).alias("_o"), F.lit(None).cast("long").alias("_z")).unionByName(
            zones.select(*keys, F.lit(None).cast("long").alias(idx), (edge * 2 + after).alias("_o"), c("zone").alias("_z")))
        return carry_last(line, {name: c("_z")}, keys=keys, order="_o").filter(c(idx).isNotNull()).select(*keys, idx, F.coalesce(name, F.lit(0)).alias(name))
    hi, lo = upto(c("start") - tolerance, 0, "_hi"), upto(c("end") + tolerance, 1, "_past")
    d = events.select(*keys, idx).join(hi, [*keys, idx]).join(lo, [*keys, idx]).withColumn("_lo", c("_past") + 1)
    return chained(d, _match, [0.0], "matched int", ["_lo", "_hi"], idx=idx, keys=keys)


def event_metrics(scored: DataFrame, thresholds: list[float], cooldown_bars: int, tolerance: int, keys: tuple[str, ...] = ("model_id", "symbol"), per: tuple[str, ...] = ("model_id",), beta: float = 0.5) -> DataFrame:
    """(per, threshold, events, zones, matched, precision, recall, fbeta) of cooled events against positive zones."""
    from barloom.operators.labels import cooldown
    at = (*keys, "threshold")
    every = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    zones = saved(positive_zones(scored, keys).withColumn("threshold", every), "zones")
    hits = scored.select(*keys, "bar_idx", "probability").withColumn("threshold", every).filter("probability >= threshold")
    events = saved(cooldown(hits, cooldown_bars, at).filter("accepted = 1").select(*at, "bar_idx"), "cooled")
    m = matched_events(events, zones, at, tolerance).groupBy(*per, "threshold").agg(F.count(F.lit(1)).alias("events"), F.sum("matched").alias("matched"))
    z = zones.groupBy(*per, "threshold").agg(F.count(F.lit(1)).alias("zones"))
    d = scored.select(*per).distinct().withColumn("threshold", every).join(m, [*per, "threshold"], "left").join(z, [*per, "threshold"], "left").na.fill(0, ["events", "matched", "zones"])
    d = d.withColumns({"precision": F.when(c("events") > 0, c("matched") / F.when(c("events") > 0, c("events"))).otherwise(0.0), "recall": F.when(c("zones") > 0, c("matched") / F.when(c("zones") > 0, c("zones"))).otherwise(0.0)})
    low = beta * beta * c("precision") + c("recall")
    return d.withColumn("fbeta", F.when(low > 0, (1 + beta * beta) * c("precision") * c("recall") / F.when(low > 0, low)).otherwise(0.0))

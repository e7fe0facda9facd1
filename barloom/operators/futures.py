"""Contract rolls, continuous series and volume profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import following
from barloom.store import saved
from barloom.functions import clock
from barloom.functions.cols import c, flag


def session_volume(cbars: DataFrame) -> DataFrame:
    """Volume, first and last bar per (symbol, market-day close, contract)."""
    return cbars.groupBy("symbol", clock.day_close().alias("session_close"), "contract_id").agg(
        F.sum("volume").alias("metric"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("bars"))


def leaders(sessions: DataFrame) -> DataFrame:
    """Winner per session: highest volume; a tie keeps the previous winner when it is among the tied, else the smallest id.

    Only the per-session tied sets (one short array per trading day) are folded in order.
    """
    top = sessions.groupBy("symbol", "session_close").agg(F.max("metric").alias("top"))
    tied = sessions.join(top, ["symbol", "session_close"]).filter("metric = top").groupBy("symbol", "session_close", "top").agg(F.array_sort(F.collect_list("contract_id")).alias("ids"))
    # a session with one leader starts a run; only the ties that follow it depend on it, so a run is what is folded
    run = F.sum(flag(F.size("ids") == 1)).over(Window.partitionBy("symbol").orderBy("session_close"))  # one row a trading day
    seq = tied.withColumn("_run", run).groupBy("symbol", "_run").agg(F.array_sort(F.collect_list(F.struct("session_close", "top", "ids"))).alias("s"))
    out_t = "array<struct<session_close:timestamp,top:double,winner:string>>"
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.array().cast(out_t).alias("out"))

    def step(a, x):
        win = F.when(F.array_contains(x["ids"], a["prev"]), a["prev"]).otherwise(x["ids"][0])
        return F.struct(win.alias("prev"), F.concat(a["out"], F.array(F.struct(x["session_close"].alias("session_close"), x["top"].alias("top"), win.alias("winner")))).alias("out"))
    return seq.select("symbol", F.explode(F.aggregate("s", zero, step)["out"]).alias("r")).select("symbol", "r.*")


def roll_calendar(sessions: DataFrame, bracket: int = 2) -> DataFrame:
    """Lead for a session is the winner of the one before it (the first leads itself); roll flags and brackets around rolls."""
    w = Window.partitionBy("symbol").orderBy("session_close")
    starts = sessions.groupBy("symbol", "session_close").agg(F.min("session_start").alias("session_start"))
    d = leaders(sessions).join(starts, ["symbol", "session_close"])
    d = d.withColumn("lead_contract", F.coalesce(F.lag("winner").over(w), c("winner")))
    d = d.withColumn("is_roll", flag(c("lead_contract") != F.lag("lead_contract").over(w)))
    return d.withColumn("in_bracket", F.max("is_roll").over(w.rowsBetween(-bracket, bracket)))


def continuous(cbars: DataFrame, schedule: DataFrame) -> DataFrame:
    """Bars of each session's lead contract only."""
    b = cbars.withColumn("session_close", clock.day_close())
    return b.join(schedule.select("symbol", "session_close", "lead_contract", "is_roll", "in_bracket"), ["symbol", "session_close"]).filter("contract_id = lead_contract")


def roll_events(cbars: DataFrame, schedule: DataFrame) -> DataFrame:
    """Seam step at the first timestamp both contracts share on or after the roll, and its running sum."""
    w = Window.partitionBy("symbol").orderBy("session_close")
    rolls = schedule.withColumn("from_contract", F.lag("lead_contract").over(w)).filter("is_roll = 1").select(
        "symbol", c("session_start").alias("effective_from"), "session_close", "from_contract", c("lead_contract").alias("to_contract"))
    pair, span = ["symbol", "from_contract", "to_contract"], Window.partitionBy("symbol").orderBy("session_close")
    px = cbars.select("symbol", "ts", "contract_id", "close")
    a = px.withColumnRenamed("contract_id", "from_contract").withColumnRenamed("close", "from_price")
    b = px.withColumnRenamed("contract_id", "to_contract").withColumnRenamed("close", "to_price")
    shared = a.join(rolls.select(*pair).distinct(), ["symbol", "from_contract"]).join(b, ["symbol", "ts", "to_contract"])  # only pairs that roll into each other
    # a roll looks ahead to the first shared bar at or after it: block scans over the reversed time line
    shared = saved(shared.withColumn("at", F.unix_timestamp("ts")), "shared-bars")
    asked = rolls.withColumn("_before", F.unix_timestamp("effective_from") - 1)
    first = following(asked, shared, pair, "_before", "at", "_at", 4096 * 3600).drop("_before").join(shared.withColumnRenamed("at", "_at"), [*pair, "_at"])
    d = first.select("symbol", "session_close", "effective_from", "from_contract", "to_contract", c("ts").alias("spread_ts"), (c("to_price") - c("from_price")).alias("roll_spread"))
    return d.withColumn("cumulative_spread", F.sum("roll_spread").over(span.rowsBetween(Window.unboundedPreceding, 0)))


def profile(bars: DataFrame, keys: list[str], tick: float = 0.25, divisor: float = 20.0, atr: int = 14) -> DataFrame:
    """Volume histogram per group: bar volume spread over price bins by overlap; bin width from the group's last average range.

    A group is one bounded window of bars (a session or an anchor), so its windows are bounded too.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    prev = F.lag("close").over(w)
    d = bars.withColumn("_tr", F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)))
    d = d.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"))))
    width = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(c("_back") <= atr, c("_tr"))).alias("_last"), F.avg("_tr").alias("_all"))
    width = width.select(*keys, F.greatest(F.when((c("_n") >= atr) & (c("_last") > 0), c("_last")).otherwise(c("_all")) / divisor, F.lit(tick)).alias("bin_width"))
    d = d.join(width, keys)
    d = d.select(*keys, "bin_width", "low", "high", "volume", F.explode(F.sequence(F.floor(c("low") / c("bin_width")), F.floor(c("high") / c("bin_width")))).alias("bin"))
    part = F.greatest(F.least("high", (c("bin") + 1) * c("bin_width")) - F.greatest("low", c("bin") * c("bin_width")), F.lit(0.0))
    rng = c("high") - c("low")
    vol = F.when(rng > 0, c("volume") * part / F.when(rng > 0, rng)).otherwise(c("volume"))
    # decimals add up the same in any order, so bins of equal volume stay equal at large volumes
    h = d.groupBy(*keys, "bin", "bin_width").agg(F.sum(vol.cast("decimal(38,18)")).cast("double").alias("volume"))
    return h.filter(c("volume") > 1e-12).withColumn("price", c("bin") * c("bin_width"))


def profile_levels(hist: DataFrame, keys: list[str], area: float = 0.7, k: float = 0.5) -> DataFrame:
    """Point of control, value area, high and low volume nodes and the shape of each histogram."""
    part = Window.partitionBy(*keys)
    order = part.orderBy(F.desc(F.round("volume", 9)), F.asc("price"))
    d = hist.withColumns({"_tot": F.sum("volume").over(part), "_cum": F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_rk": F.row_number().over(order),
                          "_m": F.avg("volume").over(part), "_s": F.stddev_pop("volume").over(part), "_lo": F.min("price").over(part), "_hi": F.max("price").over(part),
                          "_mu": F.sum(c("volume") * c("price")).over(part) / F.sum("volume").over(part)})
    before = F.coalesce(F.lag("_cum").over(order), F.lit(0.0))
    d = d.withColumn("_in", (c("_rk") == 1) | (c("_cum") <= area * c("_tot") + 1e-9) | ((before < area * c("_tot") - 1e-9) & (c("_cum") > area * c("_tot"))))
    dev = c("price") - c("_mu")
    high_node, low_node = F.round(c("volume") - c("_m") - k * c("_s"), 9) >= 0, F.round(c("volume") - c("_m") + k * c("_s"), 9) <= 0  # equal volumes do not depend on the order of sums
    g = d.groupBy(*keys).agg(
        F.max_by("price", F.struct(F.round("volume", 9), -c("price"))).alias("poc"), F.max(F.when(c("_in"), c("price"))).alias("vah"), F.min(F.when(c("_in"), c("price"))).alias("val"),
        F.sum("volume").alias("total_volume"), F.sum(flag(high_node)).alias("hvn_count"), F.sum(flag(low_node)).alias("lvn_count"),
        F.array_sort(F.collect_list(F.when(high_node, c("price")))).alias("hvn"), F.array_sort(F.collect_list(F.when(low_node, c("price")))).alias("lvn"),
        (F.sum(c("volume") * dev * dev) / F.sum("volume")).alias("_v"), (F.sum(c("volume") * dev * dev * dev) / F.sum("volume")).alias("_q"),
        (F.sum(F.when(c("price") >= c("_hi") - 0.25 * (c("_hi") - c("_lo")), c("volume")).otherwise(0.0)) / F.sum("volume")).alias("top_share"),
        (F.sum(F.when(c("price") <= c("_lo") + 0.25 * (c("_hi") - c("_lo")), c("volume")).otherwise(0.0)) / F.sum("volume")).alias("bottom_share"),
        (F.max("volume") / F.sum("volume")).alias("poc_share"))
    sd = F.sqrt("_v")
    g = g.withColumn("skew", F.when(c("_v") > 1e-12, c("_q") / F.when(c("_v") > 1e-12, sd * sd * sd)).otherwise(0.0))
    shape = F.when((c("bottom_share") > 0.35) & (c("skew") > 0.5), "P").when((c("top_share") > 0.35) & (c("skew") < -0.5), "b").otherwise("D")
    return g.withColumn("shape", shape).drop("_v", "_q")


def naked_levels(levels: DataFrame, bars: DataFrame, price: str = "poc") -> DataFrame:
    """First bar after a level's birth that trades through it. Day ranges screen the candidates, so a level meets only the bars of days that reach it."""
    b = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min("low").alias("dlo"), F.max("high").alias("dhi"))
    # a day's range may hold the level while no single bar does, so every candidate day is checked bar by bar
    days = levels.join(b, "symbol").filter((c("day") > c("born")) & c(price).between(c("dlo"), c("dhi"))).select("symbol", "born", price, "day")
    inside = days.join(bars.select("symbol", F.to_date("ts").alias("day"), "low", "high", "bar_idx"), ["symbol", "day"]).filter(c(price).between(c("low"), c("high")))
    first = inside.groupBy("symbol", "born", price).agg(F.min("bar_idx").alias("touched_idx"))
    return levels.join(first, ["symbol", "born", price], "left")

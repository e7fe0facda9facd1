"""Events, forward barriers, zones, concurrency and weights. Paths are bounded equi joins by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators.blocks import reached, running
from barloom.operators.relate import path
from barloom.store import saved


def first_touch(events: DataFrame, bars: DataFrame, entry: Column, target: Column, stop: Column, first: Column, horizon: int, target_first: bool = True) -> DataFrame:
    """First bar whose range reaches target or stop. On a shared bar the target wins when ``target_first``, else the stop.

    Adds outcome (tp / sl / timeout), exit_idx, exit_price and bars_held; events without a forward bar keep nulls.
    """
    ev = events.withColumns({"entry": entry, "target_px": target, "stop_px": stop})
    p = path(ev, bars, first, first + horizon - 1, ("high", "low", "close"))
    up = c("side") == 1
    tp = F.when(up, c("p_high") >= c("target_px")).otherwise(c("p_low") <= c("target_px"))
    sl = F.when(up, c("p_low") <= c("stop_px")).otherwise(c("p_high") >= c("stop_px"))
    kind = F.when(tp, "tp").when(sl, "sl") if target_first else F.when(sl, "sl").when(tp, "tp")
    keys = ["symbol", "bar_idx"]
    hit = p.withColumn("_k", kind).groupBy(*keys).agg(
        F.min(F.when(c("_k").isNotNull(), F.struct("path_idx", c("_k").alias("kind")))).alias("_h"), F.max(F.struct("path_idx", "p_close")).alias("_z"))
    out = ev.join(hit, keys, "left")
    ex = F.when(c("_h.kind") == "tp", c("target_px")).when(c("_h.kind") == "sl", c("stop_px")).otherwise(c("_z.p_close"))
    return out.withColumns({
        "outcome": F.when(c("_z").isNotNull(), F.coalesce(c("_h.kind"), F.lit("timeout"))), "exit_idx": F.coalesce(c("_h.path_idx"), c("_z.path_idx")), "exit_price": ex,
        "ret": (ex - c("entry")) * c("side"), "bars_held": F.coalesce(c("_h.path_idx"), c("_z.path_idx")) - c("bar_idx")}).drop("_h", "_z")


def zones(events: DataFrame, bars: DataFrame, pre: int, post: int, value: Column) -> DataFrame:
    """Per bar: is it inside any event's zone, and the best value over the zones covering it."""
    z = path(events.withColumn("_q", value), bars, F.greatest(c("bar_idx") - pre, F.lit(0)), c("bar_idx") + post, ())
    best = z.groupBy("symbol", "path_idx").agg(F.max("_q").alias("zone_value"), F.lit(1).alias("in_zone")).withColumnRenamed("path_idx", "bar_idx")
    return bars.join(best, ["symbol", "bar_idx"], "left").withColumns({"in_zone": F.coalesce("in_zone", F.lit(0)), "zone_value": F.coalesce("zone_value", F.lit(0.0))})


def concurrency(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Open event windows per bar: +1 at the start, -1 after the end, running sum."""
    d = windows.select("symbol", c("start_idx").alias("bar_idx"), F.lit(1).alias("x")).unionByName(windows.select("symbol", (c("end_idx") + 1).alias("bar_idx"), F.lit(-1).alias("x")))
    step = d.groupBy("symbol", "bar_idx").agg(F.sum("x").alias("_x"))
    return running(bars.join(step, ["symbol", "bar_idx"], "left"), sums={"concurrency": c("_x")}).drop("_x")


def sample_weights(conc: Column, positive: Column, quality: Column, floor: float = 0.25) -> Column:
    """Inverse concurrency times floored quality on positives, plain inverse concurrency elsewhere."""
    inv = 1.0 / F.greatest(conc, F.lit(1))
    return F.when(positive, inv * F.greatest(quality, F.lit(floor))).otherwise(inv)


def uniqueness(windows: DataFrame, conc: DataFrame) -> DataFrame:
    """Mean inverse concurrency over each event's window."""
    p = path(windows, conc, c("start_idx"), c("end_idx"), ("concurrency",))
    return p.groupBy("symbol", "start_idx", "end_idx").agg(F.avg(1.0 / c("p_concurrency")).alias("uniqueness"))


def islands(df: DataFrame, cond_new: Column, keys=("symbol",), order: str = "bar_idx", name: str = "island", size: int = 4096) -> DataFrame:
    """Running count of segment starts."""
    return running(df, sums={name: flag(cond_new)}, keys=keys, order=order, size=size)


def cooldown(events: DataFrame, bars_apart: int, keys=("symbol",), idx: str = "bar_idx") -> DataFrame:
    """Greedy thinning: keep an event more than ``bars_apart`` after the last kept one."""
    nodes = events.select(*keys, idx).distinct().withColumn("until", c(idx) + bars_apart)
    kept = reached(nodes, keys, idx).withColumn("accepted", F.lit(1))
    return events.join(kept, [*keys, idx], "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))


def admit(trades: DataFrame, keys=("symbol",), start: str = "bar_idx", end: str = "exit_idx", first: tuple[str, ...] = ()) -> DataFrame:
    """One open position at a time: a trade is taken only after the last taken one has exited.

    Of trades that start together one is taken: by the columns of ``first``, then exit, then a hash of the row; rows equal in every column count as one
    trade. An open trade (null exit) blocks all later ones. Exits do not lie before starts.
    """
    trades = trades.withColumn("_id", F.xxhash64(*trades.columns))
    heads = trades.groupBy(*keys, start).agg(F.min(F.struct(*first, F.coalesce(c(end), F.lit(1 << 60)).alias("_e"), c("_id"), c(end).alias("_end"))).alias("_h"))
    heads = saved(heads.select(*keys, start, c("_h._id").alias("_id"), c("_h._end").alias("until")), "heads")
    kept = heads.join(reached(heads, keys, start), [*keys, start]).select(*keys, start, "_id", F.lit(1).alias("admitted"))
    return trades.join(kept, [*keys, start, "_id"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(0))).drop("_id")

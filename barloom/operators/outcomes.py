"""Tick rounding, barrier outcomes, costs and admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def tick_up(price: Column, tick: float) -> Column:
    return F.ceil(price / tick - EPS) * tick


def tick_down(price: Column, tick: float) -> Column:
    return F.floor(price / tick + EPS) * tick


def signal_outcome(signals, schedule, bars, timeout: int, tick: float, target_atr: float, stop_atr: float):
    """Outcome on an expected-open calendar: entry at the first slot strictly after the signal is known, barriers rounded outward to
    the tick, a missing slot before the end is a data gap, the stop is assumed first on a shared bar and pays the open when gapped.

    ``schedule(symbol, slot, ts)`` numbers the expected opens; ``signals`` carry ``known_slot`` (last slot at or before the decision).
    """
    from barloom.operators.relate import path
    slots = schedule.join(bars.select("symbol", "ts", "open", "high", "low", "close"), ["symbol", "ts"], "left").withColumn("filled", F.col("open").isNotNull().cast("int"))
    entry = slots.select("symbol", (F.col("slot") - 1).alias("known_slot"), F.col("open").alias("entry"))
    s = signals.join(entry, ["symbol", "known_slot"], "left")
    up = F.col("side") == 1
    e, a = F.col("entry"), F.col("atr")
    s = s.withColumns({
        "target_px": F.when(up, tick_up(e + target_atr * a, tick)).otherwise(tick_down(e - target_atr * a, tick)),
        "stop_px": F.when(up, tick_down(e - stop_atr * a, tick)).otherwise(tick_up(e + stop_atr * a, tick))})
    p = path(s, slots, F.col("known_slot") + 1, F.col("known_slot") + timeout, ("filled", "open", "high", "low", "close"), idx="slot")
    sl = F.when(up, F.col("p_low") <= F.col("stop_px")).otherwise(F.col("p_high") >= F.col("stop_px"))
    tp = F.when(up, F.col("p_high") >= F.col("target_px")).otherwise(F.col("p_low") <= F.col("target_px"))
    gapped = F.when(up, F.col("p_open") <= F.col("stop_px")).otherwise(F.col("p_open") >= F.col("stop_px"))
    kind = F.when(F.col("p_filled") == 0, "DATA_GAP").when(sl, "STOP").when(tp, "TARGET")
    px = F.when(kind == "STOP", F.when(gapped, F.col("p_open")).otherwise(F.col("stop_px"))).when(kind == "TARGET", F.col("target_px"))
    p = p.withColumns({"_kind": kind, "_px": px})
    g = p.groupBy("symbol", "bar_idx").agg(
        F.min(F.when(F.col("_kind").isNotNull(), F.struct("step", F.col("_kind").alias("kind"), F.col("_px").alias("px")))).alias("h"),
        F.max(F.struct("step", F.col("p_close").alias("px"))).alias("z"))
    out = s.join(g, ["symbol", "bar_idx"], "left")
    whole = F.col("z.step") == timeout - 1
    move = (F.coalesce(F.col("h.px"), F.col("z.px")) - e) * F.col("side")
    status = (F.when(F.col("z").isNull(), "UNRESOLVED").when(F.col("h.kind").isNotNull(), F.col("h.kind")).when(~whole, "UNRESOLVED")
              .when(move > 0, "TIMEOUT_WIN").when(move < 0, "TIMEOUT_LOSS").otherwise("TIMEOUT_FLAT"))
    return out.withColumns({"status": status, "move": F.when(~status.isin("DATA_GAP", "UNRESOLVED"), move)}).drop("h", "z")


def position_costs(trades, spreads, slippage: float, commission: float):
    """Half the session spread at entry and at exit plus slippage and commission, from a small per-session table."""
    a = spreads.select(F.col("session_regime").alias("entry_session"), F.col("spread").alias("_es"))
    b = spreads.select(F.col("session_regime").alias("exit_session"), F.col("spread").alias("_xs"))
    t = trades.join(F.broadcast(a), "entry_session", "left").join(F.broadcast(b), "exit_session", "left")
    return t.withColumn("cost", (F.col("_es") + F.col("_xs")) / 2.0 + 2 * slippage + commission).drop("_es", "_xs")


def abstain(frame, rules):
    """First matching reason in order; rules are (reason, condition)."""
    return frame.withColumn("abstain_reason", F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def quarter_folds(frame, ts: str, min_train_quarters: int, purge_days: int):
    """Quarter-aligned test windows with an expanding, purged training span; one small row per fold."""
    ends = frame.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    q = ends.select("a", F.explode(F.sequence(F.date_trunc("quarter", "a"), F.date_trunc("quarter", "b"), F.expr("INTERVAL 3 MONTHS"))).alias("test_start"))
    q = q.filter(F.months_between("test_start", F.date_trunc("quarter", "a")) >= 3 * min_train_quarters)
    return q.select(F.col("a").alias("train_start"), (F.col("test_start") - F.expr(f"INTERVAL {purge_days} DAYS")).alias("train_end"), "test_start",
                    F.add_months("test_start", 3).cast("timestamp").alias("test_end"))

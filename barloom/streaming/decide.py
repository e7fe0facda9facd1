"""Stateful decisions: each model keeps the position of its last accepted signal between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.files import scratch
from barloom.streaming.bars import run_to_table


def decision_stream(m, signals: DataFrame, cooldown: int) -> DataFrame:
    """Signals as a file stream; a signal is accepted when more than ``cooldown`` bars passed since the last accepted one of its key."""
    spark = signals.sparkSession
    src = scratch(spark, "signals")
    signals.write.parquet(src)
    stream = spark.readStream.schema(signals.schema).parquet(src)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("bar_idx", kind="stable")
        taken = []
        for i in rows["bar_idx"]:
            ok = last is None or i - last > cooldown
            last = int(i) if ok else last
            taken.append(int(ok))
        if last is not None:
            state.update((last,))
        yield rows.assign(accepted=taken)[["model_id", "symbol", "bar_idx", "accepted"]]

    out = stream.groupBy("model_id", "symbol").applyInPandasWithState(
        step, "model_id string, symbol string, bar_idx long, accepted int", "last long", "append", "NoTimeout")
    return run_to_table(out, "decisions")


def settle_stream(m, events: DataFrame, bars: DataFrame, later: int, within: str = "90 days") -> DataFrame:
    """Stream-stream join: an open event is closed by the ``later``-th bar after it, whichever side arrives first.

    Both sides wait in state under the bar position they need, so files may come in any order within the watermark of ``within``. The closing bar lies
    at most ``within`` after its event; what can no longer match is dropped from state.
    """
    spark, sources = events.sparkSession, []
    for name, rows in (("open-events", events), ("later-bars", bars)):
        src = scratch(spark, name)
        rows.write.parquet(src)
        sources.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src))
    opened = sources[0].withWatermark("ts", within).withColumn("settle_idx", F.col("bar_idx") + later).withColumnRenamed("close", "entry")
    closing = sources[1].select(F.col("symbol").alias("s"), F.col("bar_idx").alias("at"), F.col("ts").alias("close_ts"), "close").withWatermark("close_ts", within)
    near = F.expr(f"symbol = s AND settle_idx = at AND close_ts > ts AND close_ts <= ts + INTERVAL {within}")
    out = opened.join(closing, near).select("symbol", "bar_idx", "side", "settle_idx", ((F.col("close") - F.col("entry")) * F.col("side")).alias("move"))
    return run_to_table(out, "settled")

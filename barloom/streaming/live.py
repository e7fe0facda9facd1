"""Live forms over file streams: stale feeds, features of new bars from a halo, and late corrections that append revisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators.blocks import BLOCK_ROWS
from barloom.sources.files import scratch

BEATS = "symbol string, status string, at_ts timestamp, last_beat timestamp"


def stretches(chunks, gap: int) -> list[list[int]]:
    """[first, last] of every stretch of times without a gap of more than ``gap``, whatever order and chunks they come in.

    Between two chunks only stretches are held: at most one per ``gap`` of the time that they span, however many times there are.
    """
    found = np.zeros((0, 2), dtype=np.int64)
    for t in chunks:
        found = np.concatenate([found, np.stack([t, t], axis=1)])
        found = found[np.argsort(found[:, 0], kind="stable")]
        ends = np.maximum.accumulate(found[:, 1])
        cut = np.flatnonzero(found[1:, 0] - ends[:-1] > gap)
        if len(found):
            found = np.stack([found[np.append(0, cut + 1), 0], ends[np.append(cut, len(found) - 1)]], axis=1)
    return found.tolist()


def heartbeats(beats: DataFrame, stale_after: int, live: bool = False) -> DataFrame:
    """One row when a feed goes stale (no beat for ``stale_after`` seconds) and one when it recovers. ``beats``: stream of (symbol, ts).

    A key keeps its last beat and whether it is stale. Live, a processing-time timer wakes a silent key; in a replay the watermark of ``ts`` is the
    clock, so a history gives the same rows however it is cut into micro-batches of rising time. Beats older than the last one change nothing.
    """
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, stale = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            if not stale:
                out.append(("stale", last + stale_after * 1_000_000, last))
            stale = True
        else:
            # a key's beats may come in any order and in several pieces, so a gap counts only when all pieces are seen
            times = (b["ts"].astype("datetime64[us]").astype("int64").to_numpy() for b in batches if len(b))
            for first, end in stretches((t if last is None else t[t > last] for t in times), stale_after * 1_000_000):
                if last is not None and first - last > stale_after * 1_000_000:
                    if not stale:
                        out.append(("stale", last + stale_after * 1_000_000, last))
                    out.append(("recovered", first, last))
                stale, last = False, end
        due = last // 1000 + stale_after * 1000 + 1
        if not live and not stale and due <= state.getCurrentWatermarkMs():
            out.append(("stale", last + stale_after * 1_000_000, last))
            stale = True
        state.update((last, stale))
        if not stale:
            if live:
                state.setTimeoutDuration(stale_after * 1000)
            else:
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame([(key[0], s, pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us")) for s, a, b in out], columns=["symbol", "status", "at_ts", "last_beat"])

    return beats.groupBy("symbol").applyInPandasWithState(step, BEATS, "last long, stale boolean", "append", "ProcessingTimeTimeout" if live else "EventTimeTimeout")


class Feed:
    """A folder that grows file by file, read as a stream; each ``push`` adds rows and drains what is new."""

    def __init__(self, spark: SparkSession, schema, name: str):
        self.spark, self.schema, self.name = spark, schema, name
        self.source, self.checkpoint = scratch(spark, name), scratch(spark, f"{name}-ck")
        spark.createDataFrame([], schema).write.parquet(self.source)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.source)

    def push(self, rows: DataFrame, start: Callable[[DataFrame], object]) -> None:
        """``start`` gets a configured writer's stream and returns a started query."""
        rows.write.mode("append").parquet(self.source)
        start(self.stream()).awaitTermination()


def into_table(stream: DataFrame, out: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RollingFeatures:
    """Features of new bars only: each micro-batch is appended to a bar table kept by blocks of positions, and the batch plan runs on the new rows and the
    ``halo`` rows before them. A micro-batch that is run again overwrites its own folder."""

    def __init__(self, spark: SparkSession, plan: Callable[[DataFrame], DataFrame], halo: int):
        self.spark, self.plan, self.halo = spark, plan, halo
        self.bars, self.out = scratch(spark, "live-bars"), scratch(spark, "live-features")

    def work(self, new: DataFrame, batch: int) -> None:
        new = new.withColumn("_blk", F.floor(c("bar_idx") / BLOCK_ROWS))
        new.write.mode("overwrite").partitionBy("_blk").parquet(f"{self.bars}/batch={batch}")
        kept = self.spark.read.option("basePath", self.bars).parquet(f"{self.bars}/batch={batch}")
        start = kept.groupBy("symbol").agg(F.min("bar_idx").alias("_from"))
        low = start.agg(F.floor((F.min("_from") - self.halo) / BLOCK_ROWS)).first()[0]
        if low is None:
            return
        seen = self.spark.read.option("basePath", self.bars).parquet(self.bars).filter((c("_blk") >= low) & (c("batch") <= batch))  # older blocks are not listed
        near = seen.join(start, "symbol").filter(c("bar_idx") >= c("_from") - self.halo)
        latest = near.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "bar_idx").orderBy(F.desc("batch")))).filter("_n = 1")
        done = self.plan(latest.drop("_n", "_blk", "batch", "_from")).join(start, "symbol").filter(c("bar_idx") >= c("_from")).drop("_from")
        done.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")

    def result(self) -> DataFrame:
        return self.spark.read.option("basePath", self.out).parquet(self.out)


class Revisions:
    """Late corrections of bars: the stretch that a correction can change is computed again and rows that changed are appended as new revisions.

    ``plan`` maps bars to values (symbol, bar_idx, ...); a value looks back over at most ``halo`` bars, so a correction at position j changes values
    from j to j + ``halo``. The pending range of each symbol is written before any work and stays until its revisions are; ``resume`` repeats what an
    interrupted run left. Each batch writes folders of its own number, so a repeated batch replaces itself and nothing is lost or doubled.
    """

    def __init__(self, spark: SparkSession, bars: DataFrame, plan: Callable[[DataFrame], DataFrame], halo: int):
        self.spark, self.plan, self.halo = spark, plan, halo
        self.versions, self.pending, self.out, self.done = (scratch(spark, f"revision-{x}") for x in ("bars", "pending", "values", "done"))
        spark.createDataFrame([(-1,)], "n long").write.parquet(f"{self.done}/batch=-1")
        self.names = [x for x in bars.columns]
        bars.withColumn("version", F.lit(0).cast("long")).write.parquet(f"{self.versions}/batch=-1")
        plan(bars).withColumns({"revision": F.lit(0).cast("long"), "observed_at": F.current_timestamp()}).write.parquet(f"{self.out}/batch=-1")

    def _read(self, path: str, batch: int) -> DataFrame:
        return self.spark.read.option("basePath", path).parquet(path).filter(c("batch") <= batch)

    def current(self, batch: int = 1 << 40) -> DataFrame:
        """Bars with the highest version of each position."""
        newest = Window.partitionBy("symbol", "bar_idx").orderBy(F.desc("version"), F.desc("batch"))
        return self._read(self.versions, batch).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(*self.names)

    def latest(self, batch: int = 1 << 40) -> DataFrame:
        """Values with the highest revision of each position."""
        newest = Window.partitionBy("symbol", "bar_idx").orderBy(F.desc("revision"))
        return self._read(self.out, batch).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")

    def work(self, corrections: DataFrame, batch: int) -> None:
        corrections.select(*self.names, "version").write.mode("overwrite").parquet(f"{self.versions}/batch={batch}")
        mine = self.spark.read.parquet(f"{self.versions}/batch={batch}")
        ranges = mine.groupBy("symbol").agg(F.min("bar_idx").alias("from"), (F.max("bar_idx") + self.halo).alias("to"))
        ranges.coalesce(1).write.mode("overwrite").parquet(f"{self.pending}/batch={batch}")
        self.reconcile(batch)

    def reconcile(self, batch: int) -> None:
        ranges = self.spark.read.parquet(f"{self.pending}/batch={batch}")
        if not ranges.isEmpty():
            rows = self.current(batch).join(ranges, "symbol").filter(c("bar_idx").between(c("from") - self.halo, c("to")))
            again = self.plan(rows.drop("from", "to")).join(ranges, "symbol").filter(c("bar_idx").between(c("from"), c("to"))).drop("from", "to")
            values = [x for x in again.columns if x not in ("symbol", "bar_idx")]
            old = self.latest(batch - 1).select("symbol", "bar_idx", "revision", F.struct(*values).alias("_old"))
            new = again.join(old, ["symbol", "bar_idx"], "left").filter(~F.struct(*values).eqNullSafe(c("_old")))
            new = new.withColumns({"revision": F.coalesce(c("revision") + 1, F.lit(0)), "observed_at": F.current_timestamp()}).drop("_old")
            new.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        self.spark.range(1).select(F.lit(batch).cast("long").alias("n")).write.mode("overwrite").parquet(f"{self.done}/batch={batch}")

    def resume(self) -> list[int]:
        """Repeat batches, in order, whose pending ranges were written but not finished."""
        started = self.spark.read.option("basePath", self.pending).parquet(self.pending).select(c("batch").cast("long").alias("n")).distinct()
        left = sorted(r.n for r in started.join(self.spark.read.parquet(f"{self.done}/batch=*"), "n", "left_anti").collect())  # a number a batch
        for b in left:
            self.reconcile(b)
        return left

"""The tables every query starts from: ticks, rolled bars and the per-contract and daily variants.

One tick scan per bar table: ticks are rolled with map-side combine, written to shared storage, then numbered from that small table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.operators.blocks import number_rows
from barloom.store import stored


def roll(df: DataFrame, bucket, keys=("symbol",), price: str = "price", order=("ts", "seq"), volume=None) -> DataFrame:
    """Open/high/low/close/volume per key and bucket; open and close follow the full ``order``, so ties are settled."""
    at = F.struct(*order)
    vol = F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume)
    return df.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        vol.alias("volume"))


def reroll(bars: DataFrame, bucket, keys=("symbol",)) -> DataFrame:
    """Bars to coarser bars."""
    return bars.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars"))


class Market:
    """Tables of one input directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # all calendars are computed from UTC instants
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({n: F.col(n).cast("timestamp") for n in ntz}) if ntz else df

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), "ts",
                                           F.col("value").alias("price"), "user_id")

    def _bars(self, name: str, rolled, keys=("symbol",), span: int = 4096 * 3600) -> DataFrame:
        raw = stored(self.spark, f"{self.root}|{name}|raw", lambda: rolled().withColumnRenamed("bucket", "ts"))
        return stored(self.spark, f"{self.root}|{name}", lambda: number_rows(raw, "ts", span, keys))

    def bars(self, seconds: int = 3600) -> DataFrame:
        """symbol, ts, open, high, low, close, volume, bar_idx."""
        return self._bars(f"bars{seconds}", lambda: roll(self.ticks, clock.floor_to("ts", seconds)), span=4096 * seconds)

    def contract_bars(self, seconds: int = 3600) -> DataFrame:
        """One bar series per (symbol, contract); contract = user_id mod 3."""
        t = self.ticks.withColumn("contract_id", F.concat(F.lit("C"), F.col("user_id") % 3))
        return self._bars(f"cbars{seconds}", lambda: roll(t, clock.floor_to("ts", seconds), ("symbol", "contract_id")),
                          ("symbol", "contract_id"), 4096 * seconds)

    def daily(self) -> DataFrame:
        """Daily bars from line items: price per unit in whole cents, ordered by order key and line number."""
        li = self.table("lineitem").select(
            F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"), "l_orderkey", "l_linenumber", "l_quantity")
        return self._bars("daily", lambda: roll(li, F.date_trunc("day", "ts"), order=("l_orderkey", "l_linenumber"), volume="l_quantity"),
                          span=4096 * 86400)

    def stage(self, name: str, build) -> DataFrame:
        """A named intermediate table, written once to shared storage so later stages scan it instead of repeating its plan."""
        return stored(self.spark, f"{self.root}|stage|{name}", build)

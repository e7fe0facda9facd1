"""Structured Streaming forms of the live path: roll-up, duplicate handling, gaps and finalised-bar ingestion over a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.sources.files import scratch


def tick_stream(spark: SparkSession, root: str) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    return s.select(c("event_type").alias("symbol"), c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"))


def roll_stream(ticks: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV; a bucket is emitted once the watermark has passed its end."""
    at = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{seconds} seconds")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))
    return g.select("symbol", c("window.start").alias("bucket"), "open", "high", "low", "close", "volume")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what is available into a Parquet table on shared storage and return a scan of it."""
    spark = stream.sparkSession
    out, ck = scratch(spark, name), scratch(spark, name + "-ck")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Repeated observations of one sequence number inside the watermark are dropped."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])

"""File sources and sinks: raw bars in many shapes in, partitioned tables and archives out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.store import checkpoint_root

BAR_SCHEMA = "symbol string, bar_idx long, ts timestamp, open double, high double, low double, close double, volume double"
CANONICAL = ("date", "time", "datetime", "timestamp", "open", "high", "low", "close", "volume")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage."""
    return f"{checkpoint_root(spark).rstrip('/')}/barloom-files/{name}-{uuid.uuid4().hex}"


def standardise(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Case-insensitive column names, one UTC ``datetime`` from whatever time columns exist, prices as doubles or null."""
    low = {n: n.strip().lower() for n in raw.columns}
    d = raw.select(*[c(n).alias(v) for n, v in low.items()])
    have = set(d.columns)
    parse = lambda x: F.coalesce(F.try_to_timestamp(x, F.lit("yyyyMMdd HH:mm:ss")), F.try_to_timestamp(x))
    if "timestamp" in have or "datetime" in have:
        t = F.try_to_timestamp(c("datetime" if "datetime" in have else "timestamp").cast("string"))
    elif "ts_event" in have:
        t = F.try_to_timestamp(c("ts_event").cast("string"))
    elif {"date", "time"} <= have:
        t = parse(F.concat_ws(" ", F.trim("date"), F.trim("time")))
    else:
        t = F.try_to_timestamp("date")
    out = d.withColumn("datetime", F.to_utc_timestamp(t, zone))
    return out.withColumns({x: F.expr(f"try_cast(`{x}` AS DOUBLE)") for x in ("open", "high", "low", "close", "volume") if x in have})


def fx_history(spark: SparkSession, path: str, zone: str = "UTC", sep: str = ";", day_first: bool = True) -> DataFrame:
    """Separated price history: day-first dates, source zone to UTC, one row per timestamp (the last line wins)."""
    raw = spark.read.csv(path, sep=sep, schema="symbol string, stamp string, open double, high double, low double, close double, volume double, line long")
    ts = F.to_utc_timestamp(F.try_to_timestamp("stamp", F.lit("dd.MM.yyyy HH:mm:ss" if day_first else "MM/dd/yyyy HH:mm:ss")), zone)
    d = raw.withColumn("ts", ts).filter("ts is not null")
    keep = F.max_by(F.struct("open", "high", "low", "close", "volume"), "line").alias("r")
    return d.groupBy("symbol", "ts").agg(keep).select("symbol", "ts", "r.*")


def provider_json(df: DataFrame, payload: str) -> DataFrame:
    """Candle arrays, bare or wrapped in ``historical`` / ``data``; rows without a usable time or prices are rejected."""
    candle = "ARRAY<STRUCT<date: STRING, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE>>"
    bare, wrap = F.from_json(payload, candle), F.from_json(payload, f"STRUCT<historical: {candle}, data: {candle}>")
    rows = df.withColumn("_c", F.explode(F.coalesce(wrap["historical"], wrap["data"], bare)))
    out = rows.select("symbol", F.try_to_timestamp("_c.date").alias("ts"), "_c.open", "_c.high", "_c.low", "_c.close", "_c.volume")
    return out.filter("ts is not null and close is not null and high >= low")


def write_dataset(df: DataFrame, path: str, by: list[str], extra: dict[str, str] | None = None) -> None:
    """Partitioned Parquet plus a one-row JSON description next to it."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    meta = df.agg(F.count(F.lit(1)).alias("rows")).withColumns({"columns": F.array(*[F.lit(x) for x in df.columns]), **{k: F.lit(v) for k, v in (extra or {}).items()}})
    meta.write.mode("overwrite").json(path + ".metadata")


def archive_month(df: DataFrame, path: str, table: str, ts: str, year: int, month: int) -> None:
    """Copy one calendar month of a table into the month archive."""
    part = df.filter((F.year(ts) == year) & (F.month(ts) == month)).withColumns({"table": F.lit(table), "year": F.lit(year), "month": F.lit(month)})
    part.write.mode("append").partitionBy("table", "year", "month").parquet(path)


def restore(current: DataFrame, archived: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """Bring archived rows back: ``ignore`` keeps current rows, ``replace`` prefers archived ones, ``abort`` raises on any clash."""
    if strategy == "replace":
        return current.join(archived.select(*keys), keys, "left_anti").unionByName(archived.select(*current.columns))
    fresh = archived.join(current.select(*keys), keys, "left_anti").select(*current.columns)
    if strategy == "abort" and not archived.join(current.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("archived keys already exist")
    return current.unionByName(fresh)


def retention_plan(rows: DataFrame, ts: str, cutoff: Column, archived_months: DataFrame) -> DataFrame:
    """Rows older than the cutoff per table, and how many of them the archive covers."""
    old = rows.filter(c(ts) < cutoff).withColumns({"year": F.year(ts), "month": F.month(ts)})
    per = old.groupBy("table", "year", "month").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    cov = per.join(archived_months.withColumn("hit", F.lit(1)), ["table", "year", "month"], "left")
    return cov.groupBy("table").agg(F.sum("n").alias("eligible"), F.min("a").alias("oldest"), F.max("b").alias("newest"),
                                    F.sum(F.when(c("hit") == 1, c("n")).otherwise(0)).alias("archived"))


def purge(rows: DataFrame, ts: str, cutoff: Column, archived_months: DataFrame) -> DataFrame:
    """What remains after deleting rows that are both old and archived."""
    d = rows.withColumns({"year": F.year(ts), "month": F.month(ts)})
    gone = archived_months.select("table", "year", "month", F.lit(1).alias("_g"))
    return d.join(gone, ["table", "year", "month"], "left").filter(~((c(ts) < cutoff) & (F.coalesce("_g", F.lit(0)) == 1))).drop("_g", "year", "month")


def canonical_view(observations: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Current row per key (last write wins) with the earliest observation time and the number of versions."""
    vals = [x for x in observations.columns if x not in keys]
    g = observations.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.struct(at, tie)).alias("r"), F.min(at).alias("first_observed_at"), F.count(F.lit(1)).alias("versions"))
    return g.select(*keys, "r.*", "first_observed_at", "versions")

"""Cases that only larger tables showed: groups in several pieces, and tables without any zone."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.llm import neardup
from barloom.operators import futures as fu
from barloom.sources.files import scratch
from barloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def test_beats_of_a_batch_in_several_pieces_show_no_false_gaps(spark):
    schema = "symbol string, ts timestamp"
    rows = [("a", T0 + dt.timedelta(seconds=50 * (i * 7 % 20))) for i in range(20)] + [("b", T0 + dt.timedelta(seconds=s)) for s in (200, 0, 210, 10, 220, 20)]
    feed, out = live.Feed(spark, spark.createDataFrame([], schema).schema, "t-pieces"), scratch(spark, "t-pieces-out")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        feed.push(spark.createDataFrame(rows, schema), lambda s: live.into_table(live.heartbeats(s.withWatermark("ts", "2000 seconds"), 60), out, feed.checkpoint))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r.symbol, r.status, int((r.at_ts - T0).total_seconds()), int((r.last_beat - T0).total_seconds())) for r in spark.read.schema(live.BEATS).parquet(out).collect())
    assert got == [("b", "recovered", 200, 20), ("b", "stale", 80, 20)]


def test_event_metrics_of_a_table_without_zones(spark, tmp_path):
    ticks = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
                                    F.lit("flat").alias("event_type"), F.lit(10.0).alias("value"), F.lit("{}").alias("props"))
    ticks.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["ag28_event_metrics"]).fetchall()
    got = [tuple(r) for r in entry.queries()["ag28_event_metrics"](spark, str(tmp_path)).collect()]
    assert len(want) == 2 and all(w[2] == 0 for w in want) and sorted(got) == sorted(want)


def test_profile_volumes_do_not_depend_on_the_order_of_bars(spark):
    rows = [("x", T0 + dt.timedelta(hours=i), p, p, p, v) for i, (p, v) in enumerate([(10.0, 0.1)] * 10 + [(20.0, 1.0)])]  # ten tenths added as doubles fall short of 1
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double, volume double")
    assert [r.volume for r in fu.profile(bars, ["symbol"]).orderBy("bin").collect()] == [1.0, 1.0]


def test_bitmap_keeps_all_asked_rows_and_few_others(spark):
    ids = spark.range(0, 20000, 10)
    got = neardup._likely(spark.range(20000).withColumn("text", F.lit("x")), ids)
    assert got.columns == ["id", "text"] and ids.join(got, "id", "left_anti").isEmpty() and got.count() < 4000
    assert neardup._likely(spark.range(5).withColumn("text", F.lit("x")), ids.filter("id < 0")).isEmpty()

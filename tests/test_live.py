"""Live streams over several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.sources.files import scratch
from barloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_stale_and_recovered_feeds(spark):
    schema = "symbol string, ts timestamp"
    feed, out = live.Feed(spark, spark.createDataFrame([], schema).schema, "t-beats"), scratch(spark, "t-heart")
    parts = [[("a", 0), ("a", 50), ("b", 10)], [("a", 90), ("a", 20)],  # a late beat changes nothing
             [("a", 300), ("a", 310)], [("c", 900)]]
    for p in parts:
        feed.push(spark.createDataFrame([(s, at(t)) for s, t in p], schema), lambda s: live.into_table(live.heartbeats(s.withWatermark("ts", "200 seconds"), 60), out, feed.checkpoint))
    got = sorted((r.symbol, r.status, int((r.at_ts - T0).total_seconds()), int((r.last_beat - T0).total_seconds())) for r in spark.read.schema(live.BEATS).parquet(out).collect())
    assert got == [("a", "recovered", 300, 90), ("a", "stale", 150, 90), ("a", "stale", 370, 310), ("b", "stale", 70, 10)]


def mean3(d):
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-2, 0)
    return d.select("symbol", "bar_idx", F.avg("close").over(w).alias("mean"))


def bars(spark, n=30):
    return spark.createDataFrame([("x", i, float(i)) for i in range(n)], "symbol string, bar_idx long, close double")


def test_rolling_features_equal_the_batch_plan(spark):
    b = bars(spark)
    feed, kept = live.Feed(spark, b.schema, "t-bars"), live.RollingFeatures(spark, mean3, 2)
    for lo, hi in ((0, 10), (10, 11), (11, 30)):
        feed.push(b.filter((F.col("bar_idx") >= lo) & (F.col("bar_idx") < hi)), lambda s: live.for_each(s, kept.work, feed.checkpoint))
    assert sorted((r.bar_idx, r.mean) for r in kept.result().collect()) == sorted((r.bar_idx, r.mean) for r in mean3(b).collect())
    assert kept.result().groupBy("batch").count().count() >= 3


def test_revisions_append_what_a_correction_changes_and_resume(spark):
    b = bars(spark)
    book = live.Revisions(spark, b, mean3, 2)
    fix = spark.createDataFrame([("x", 10, 40.0, 1)], "symbol string, bar_idx long, close double, version long")
    book.work(fix, 0)
    rows = book.latest().collect()
    assert {r.bar_idx for r in rows if r.revision == 1} == {10, 11, 12}
    assert all(r.observed_at is not None for r in rows)
    book.work(spark.createDataFrame([("x", 10, 99.0, 0)], fix.schema), 1)  # an older version changes nothing
    assert book.latest().filter("revision > 1").count() == 0
    real, book.reconcile = book.reconcile, lambda n: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        book.work(spark.createDataFrame([("x", 20, 0.0, 3)], fix.schema), 2)
    except RuntimeError:
        pass
    book.reconcile = real
    assert book.latest().filter("bar_idx = 20").first().revision == 0  # the run died before it could append
    assert book.resume() == [2] and book.resume() == []
    assert book.latest().filter("bar_idx = 20").first().revision == 1
    final = {r.bar_idx: r.mean for r in mean3(book.current()).collect()}
    assert {r.bar_idx: r.mean for r in book.latest().collect()} == final

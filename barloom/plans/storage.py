"""SRC and SM rows, ledgers (JN13, JN14, JN27, JN28, OP14-OP18) and table-level reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.functions.text import content_hash
from barloom.operators import features as ff
from barloom.operators import resample
from barloom.operators.blocks import blocked
from barloom.plans.base import FUT
from barloom.plans.registry import S, query, s_flag, s_lag, shared
from barloom.functions import clock
from barloom.sources import files
from barloom.streaming import bars as sb

KEY = "symbol:s bar_idx:l "
BAR = "symbol:s ts:t open high low close volume"


@query("src01_bar_file_scan", "symbol:s ts:t close", "SELECT * FROM bars")
def _(m):
    p = files.scratch(m.spark, "csv")
    m.bars().select("symbol", "bar_idx", "ts", "open", "high", "low", "close", "volume").write.csv(p, header=True)
    return m.spark.read.schema(files.BAR_SCHEMA).csv(p, header=True).select("symbol", "ts", "close")


@query("src02_schema_normalisation", "symbol:s datetime:t open close volume", "SELECT symbol, ts AS datetime, CASE WHEN bar_idx % 10 = 0 THEN NULL ELSE open END AS open, close, volume FROM bars")
def _(m):
    b = m.bars()
    raw = b.select(c("symbol").alias("Symbol"), F.date_format("ts", "yyyyMMdd").alias(" Date"), F.date_format("ts", "HH:mm:ss").alias("TIME"),
                   F.when(c("bar_idx") % 10 == 0, "n/a").otherwise(c("open").cast("string")).alias("Open"), c("close").cast("string").alias("CLOSE"), c("volume").alias("Volume"))
    return files.standardise(raw)


@query("src03_fx_history", BAR, "SELECT * FROM bars")
def _(m):
    p = files.scratch(m.spark, "fx")
    b = m.bars()
    row = b.select("symbol", F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("stamp"), "open", "high", "low", "close", "volume", c("bar_idx").alias("line"))
    row.withColumns({"close": c("close") - 1, "line": c("line") - 1}).filter("line % 4 = 0").unionByName(row).write.csv(p, sep=";")
    return files.fx_history(m.spark, p)


@query("src04_live_csv", BAR + " asset:s timeframe:s", "SELECT *, upper(symbol) AS asset, '1h' AS timeframe FROM bars")
def _(m):
    p = files.scratch(m.spark, "live")
    m.bars().select("symbol", "bar_idx", "ts", "open", "high", "low", "close", "volume").write.csv(p)
    from barloom.functions.text import asset_symbol
    return m.spark.read.schema(files.BAR_SCHEMA).csv(p).withColumns({"asset": asset_symbol("symbol"), "timeframe": F.lit("1h")})


@query("src05_provider_json", BAR, "SELECT * FROM bars")
def _(m):
    candle = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), "open", "high", "low", "close", "volume")
    pay = m.bars().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.collect_list(candle).alias("rows"))
    text = F.when(F.dayofmonth("day") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(c("rows").alias("historical"))))
    return files.provider_json(pay.select("symbol", text.alias("payload")), "payload")


@query("src06_incremental_source", "symbol:s seq:l ts:t price", "SELECT * FROM ticks")
def _(m):
    return sb.run_to_table(sb.deduplicated(sb.tick_stream(m.spark, m.root)), "ticks")


@query("src07_range_scan", KEY + "close", "SELECT * FROM bars WHERE symbol IN ('view', 'click') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(m):
    return m.bars().filter(c("symbol").isin("view", "click") & c("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))).orderBy("symbol", "ts")


@query("src08_canonical_upsert", "user_id:l event_type:s value first_observed_at:t versions:l", """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, min(ts) AS first_observed_at, count(*) AS versions FROM events GROUP BY 1, 2""")
def _(m):
    return files.canonical_view(m.table("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")


@query("src09_dataset_sink", KEY + "atr_14", "SELECT * FROM vol")
def _(m):
    p = files.scratch(m.spark, "dataset")
    files.write_dataset(blocked(m.bars(), ff.volatility, before=61).select("symbol", "bar_idx", "atr_14"), p, ["symbol"], {"timezone": "UTC"})
    return m.spark.read.schema("bar_idx long, atr_14 double, symbol string").parquet(p)


# parts by each symbol's own length: the first six tenths of its bars, the next two, the rest
SPLIT = "CASE WHEN bar_idx < t1 THEN 'train' WHEN bar_idx < t2 THEN 'val' ELSE 'test' END"
shared("bounds", "SELECT symbol, count(*) * 6 // 10 AS t1, count(*) * 8 // 10 AS t2 FROM bars GROUP BY 1")


def bounds(m):
    """(symbol, t1, t2): where validation and test begin."""
    return m.bars().groupBy("symbol").agg(F.expr("count(*) * 6 div 10").alias("t1"), F.expr("count(*) * 8 div 10").alias("t2"))


def _splits(m):
    d = m.bars().join(bounds(m), "symbol")
    return d.withColumns({"split": F.expr(SPLIT), "target": F.lit("up"), "label": flag(c("close") > c("open"))}).select("symbol", "bar_idx", "close", "label", "target", "split")


@query("src10_split_sink", "split:s rows:l positives:l", f"SELECT {SPLIT} AS split, count(*) AS rows, sum(CASE WHEN close > open THEN 1 ELSE 0 END) AS positives FROM bars JOIN bounds USING (symbol) GROUP BY 1")
def _(m):
    p = files.scratch(m.spark, "splits")
    _splits(m).write.partitionBy("target", "split").parquet(p)
    return m.spark.read.parquet(p).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))


@query("src11_split_scan", KEY + "close label:l", f"SELECT *, CASE WHEN close > open THEN 1 ELSE 0 END AS label FROM bars JOIN bounds USING (symbol) WHERE bar_idx >= t2")
def _(m):
    p = files.scratch(m.spark, "splits")
    _splits(m).write.partitionBy("target", "split").parquet(p)
    d = m.spark.read.parquet(p).filter("split = 'test'")
    ok = c("close").isNotNull() & ~F.isnan("close") & c("label").isin(0, 1)
    return d.withColumn("close", F.when(ok, c("close")).otherwise(F.raise_error(F.lit("split holds unusable rows")).cast("double")))


_ORD = "SELECT o_orderkey, o_orderdate AS ts, o_totalprice, 'orders' AS tab FROM orders"


def _orders(m):
    return m.table("orders").select("o_orderkey", c("o_orderdate").alias("ts"), "o_totalprice").withColumn("table", F.lit("orders"))


@query("src12_monthly_archive", "o_orderkey:l ts:t o_totalprice", "SELECT o_orderkey, o_orderdate AS ts, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 5")
def _(m):
    p = files.scratch(m.spark, "archive")
    files.archive_month(_orders(m).drop("table"), p, "orders", "ts", 1997, 5)
    return m.spark.read.parquet(p).filter("`table` = 'orders' and year = 1997 and month = 5")


@query("src13_archive_restore", "strategy:s year:l month:l rows:l total:d2", """SELECT strategy, year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS rows, sum(CASE WHEN strategy = 'replace' OR (strategy = 'ignore' AND gone) OR (strategy = 'abort' AND gone) THEN o_totalprice + 1 ELSE o_totalprice END) AS total
 FROM (SELECT *, month(o_orderdate) % 3 = 0 AS gone FROM orders) CROSS JOIN (VALUES ('ignore'), ('replace'), ('abort')) s(strategy) GROUP BY 1, 2, 3""")
def _(m):
    """Every month is archived, every third one purged; all are restored. The abort strategy brings back only months that are gone, so nothing clashes."""
    p = files.scratch(m.spark, "archive")
    o, gone = _orders(m), F.month("ts") % 3 == 0
    o.withColumn("o_totalprice", c("o_totalprice") + 1).withColumns({"year": F.year("ts"), "month": F.month("ts")}).write.partitionBy("table", "year", "month").parquet(p)
    arch, kept = m.spark.read.schema("o_orderkey long, ts timestamp, o_totalprice double, `table` string, year int, month int").parquet(p), o.filter(~gone)
    back = lambda s: files.restore(kept, arch.filter("month % 3 = 0") if s == "abort" else arch, ["o_orderkey"], s).withColumn("strategy", F.lit(s))
    every = back("ignore").unionByName(back("replace")).unionByName(back("abort"))
    return every.groupBy("strategy", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total"))


_ARCH = "(year(o_orderdate) < 1997 AND month(o_orderdate) <> 3)"


def _months(m):
    return _orders(m).filter("year(ts) < 1997 and month(ts) <> 3").select("table", F.year("ts").alias("year"), F.month("ts").alias("month")).distinct()


def _cut():
    return F.lit("1997-06-01").cast("timestamp")


@query("src14_retention_plan", "eligible:l oldest:t newest:t archived:l", f"SELECT count(*) AS eligible, min(o_orderdate) AS oldest, max(o_orderdate) AS newest, count(*) FILTER (WHERE {_ARCH[1:]} AS archived FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01'")
def _(m):
    return files.retention_plan(_orders(m), "ts", _cut(), _months(m))


@query("src15_retention_purge", "rows:l total:d2", f"SELECT count(*) AS rows, sum(o_totalprice) AS total FROM orders WHERE NOT {_ARCH}")
def _(m):
    return files.purge(_orders(m), "ts", _cut(), _months(m)).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total"))


@query("src16_raw_snapshots", KEY + "feature:s value state:s", """SELECT symbol, bar_idx, feature, value, CASE WHEN value IS NULL THEN 'missing' ELSE 'available' END AS state FROM (SELECT symbol, bar_idx, unnest(['atr_14', 'atr_50']) AS feature, unnest([atr_14, atr_50]) AS value FROM vol)""")
def _(m):
    d = blocked(m.bars(), ff.volatility, before=61)
    long = d.selectExpr("symbol", "bar_idx", "stack(2, 'atr_14', atr_14, 'atr_50', atr_50) as (feature, value)")
    return long.withColumn("state", F.when(c("value").isNull(), "missing").otherwise("available"))


@query("src17_tagged_bar_sink", "symbol:s contract_id:s ts:t close is_roll:l", f"SELECT b.*, r.is_roll FROM cbars b JOIN roll r ON r.symbol = b.symbol AND r.lead_contract = b.contract_id AND r.session_close = (date_trunc('day', b.ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' - INTERVAL 17 HOUR) + INTERVAL 41 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'")
def _(m):
    from barloom.operators import futures as fu
    from barloom.plans.futures import schedule
    p = files.scratch(m.spark, "tagged")
    fu.continuous(m.contract_bars(), schedule(m)).select("symbol", "contract_id", "ts", "close", "is_roll").write.partitionBy("symbol").parquet(p)
    return m.spark.read.parquet(p)


@query("sm01_rollup_stream", BAR.replace("ts:t", "bucket:t"), "SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2 HAVING time_bucket(INTERVAL '4 hours', min(ts)) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE")
def _(m):
    return sb.run_to_table(sb.roll_stream(sb.tick_stream(m.spark, m.root), 14400), "rollup")


GAPS = f"""SELECT symbol, ts, min(slot) AS expected_ts, count(*) AS gap_size FROM (SELECT b.symbol, b.ts, g.slot FROM (SELECT *, lag(ts) OVER ({S}) AS p FROM bars) b, LATERAL (SELECT unnest(generate_series(b.p + INTERVAL 1 HOUR, b.ts - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS slot) g WHERE b.p IS NOT NULL)
 WHERE {FUT.replace('ts AT', 'slot AT')} GROUP BY 1, 2"""


@query("sm02_gap_detection", "symbol:s ts:t expected_ts:t gap_size:l", GAPS)
def _(m):
    return resample.gaps(m.bars(), 3600, clock.futures_open)


@query("sm03_duplicates_stream", "symbol:s ticks:l", "SELECT symbol, count(*) AS ticks FROM ticks GROUP BY 1")
def _(m):
    s = sb.tick_stream(m.spark, m.root)
    return sb.run_to_table(sb.deduplicated(s.unionByName(s.filter("seq % 5 = 0"))), "dedup").groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"))


@query("sm04_gap_repair", BAR.replace("ts:t", "bucket:t"), "SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2")
def _(m):
    """Aggregates built without the recovered bars are recomputed only in the buckets those bars touch."""
    b = m.bars()
    recovered = b.filter("bar_idx % 29 = 0")
    stale = resample.by_time(b.filter("bar_idx % 29 <> 0"), 14400)
    hit = recovered.select("symbol", clock.floor_to("ts", 14400).alias("bucket")).distinct()
    fixed = resample.by_time(b.withColumn("bucket", clock.floor_to("ts", 14400)).join(hit, ["symbol", "bucket"], "left_semi").drop("bucket"), 14400)
    return stale.join(hit, ["symbol", "bucket"], "left_anti").unionByName(fixed)


@query("sm11_bar_versions", "user_id:l event_type:s changes:l", "SELECT user_id, event_type, count(*) AS changes FROM (SELECT *, lag(floor(value / 50)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> floor(value / 50) GROUP BY 1, 2")
def _(m):
    from barloom.operators.blocks import carry_last
    e = m.table("events").withColumns({"h": content_hash({"v": F.floor(c("value") / 50).cast("string")}), "at": F.unix_micros("ts")})
    e = carry_last(e, {"p": c("h")}, keys=("user_id", "event_type"), order="at", size=86_400_000_000, strict=True)
    return e.filter(c("p").isNull() | (c("p") != c("h"))).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("changes"))


# ---- ledgers ----------------------------------------------------------------------------------------------------------------
@query("jn13_nth_following_bar", KEY + "settle_ts:t settled:l", "SELECT e.symbol, e.bar_idx, b.ts AS settle_ts, CASE WHEN b.ts IS NULL THEN 0 ELSE 1 END AS settled FROM ev e LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 20")
def _(m):
    from barloom.plans.trade import events
    b = m.bars().select("symbol", (c("bar_idx") - 20).alias("bar_idx"), c("ts").alias("settle_ts"))
    return events(m).join(b, ["symbol", "bar_idx"], "left").withColumn("settled", flag(c("settle_ts").isNotNull()))


@query("jn14_anti_join_recovery", KEY, "SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM lb06 WHERE lb06.symbol = ev.symbol AND lb06.bar_idx = ev.bar_idx AND tier <> 'D')")
def _(m):
    from barloom.plans.trade import events, quality
    return events(m).join(quality(m).filter("tier <> 'D'").select("symbol", "bar_idx"), ["symbol", "bar_idx"], "left_anti")


@query("jn27_trade_set_comparison", "part:s n:l pnl", """SELECT 'shared' AS part, count(*) AS n, sum(pnl) AS pnl FROM trades WHERE family = 'sweep' AND side = 1 UNION ALL SELECT 'rejected', count(*), sum(pnl) FROM trades WHERE family = 'sweep' AND side = -1 UNION ALL SELECT 'added', count(*), sum(pnl) FROM trades WHERE family <> 'sweep' AND side = 1""")
def _(m):
    from barloom.plans.trade import trades
    t, k = trades(m), ["symbol", "bar_idx"]
    a, b = t.filter("family = 'sweep'"), t.filter("side = 1")
    n = lambda d, p: d.agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl")).withColumn("part", F.lit(p))
    return n(a.join(b.select(*k), k, "left_semi"), "shared").unionByName(n(a.join(b.select(*k), k, "left_anti"), "rejected")).unionByName(n(b.join(a.select(*k), k, "left_anti"), "added"))


@query("outcome14_signal_markouts", KEY + "h:l units open_flag:l", "SELECT e.symbol, e.bar_idx, h.h, (b.close - e.close) * e.side / 0.1 AS units, CASE WHEN b.close IS NULL THEN 1 ELSE 0 END AS open_flag FROM ev e CROSS JOIN (VALUES (1), (6), (12)) h(h) LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + h.h")
def _(m):
    from barloom.plans.trade import events
    e = events(m).withColumn("h", F.explode(F.array(*[F.lit(x) for x in (1, 6, 12)]))).withColumn("at", c("bar_idx") + c("h"))
    b = m.bars().select("symbol", c("bar_idx").alias("at"), c("close").alias("px"))
    return e.join(b, ["symbol", "at"], "left").withColumns({"units": (c("px") - c("close")) * c("side") / 0.1, "open_flag": flag(c("px").isNull())})


@query("outcome17_followup_bars", "symbol:s event_idx:l bar_idx:l", "SELECT e.symbol, e.bar_idx AS event_idx, b.bar_idx FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.ts > e.ts AND b.ts <= e.ts + INTERVAL 3 HOUR")
def _(m):
    from barloom.operators.relate import within
    from barloom.plans.trade import events
    z = events(m).select("symbol", c("bar_idx").alias("event_idx"), (c("ts") + F.expr("INTERVAL 1 SECOND")).alias("lo"), (c("ts") + F.expr("INTERVAL 3 HOURS")).alias("hi"))
    return within(m.bars().select("symbol", "bar_idx", "ts"), z, "ts", "lo", "hi", 4 * 3600)


@query("ag61_content_fingerprint", "symbol:s rows:l distinct_versions:l", "SELECT symbol, count(*) AS rows, count(DISTINCT (ts, open, high, low, close, volume)) AS distinct_versions FROM bars GROUP BY 1")
def _(m):
    h = content_hash({x: c(x).cast("string") for x in ("symbol", "ts", "open", "high", "low", "close", "volume")})
    return m.bars().withColumn("v", h).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("v").alias("distinct_versions"))


@query("ag44_imputation_statistics", "column_name:s skewness:d4 fill:d4", """SELECT 'close' AS column_name, skewness(close) AS skewness, CASE WHEN abs(skewness(close)) > 1 THEN quantile_cont(close, 0.5) ELSE avg(close) END AS fill FROM bars UNION ALL
 SELECT 'volume', skewness(volume), CASE WHEN abs(skewness(volume)) > 1 THEN quantile_cont(volume, 0.5) ELSE avg(volume) END FROM bars""")
def _(m):
    from barloom.operators.prepare import fill_statistics
    return fill_statistics(m.bars(), ["close", "volume"])


@query("ag45_constant_columns", "column_name:s distinct_values:l variance:d4 constant:l", """SELECT 'close' AS column_name, count(DISTINCT close) AS distinct_values, var_samp(close) AS variance, 0 AS constant FROM bars UNION ALL SELECT 'one', 1, 0.0, 1""")
def _(m):
    from barloom.operators.prepare import column_profile
    return column_profile(m.bars().withColumn("one", F.lit(1.0)), ["close", "one"])


@query("ml03_chronological_split", KEY + "split:s", """SELECT symbol, bar_idx, CASE WHEN rn < t1 THEN 'train' WHEN rn < t2 AND bar_idx >= g1 + 24 THEN 'val' WHEN rn >= t2 AND bar_idx >= g2 + 24 THEN 'test' END AS split FROM (
 SELECT *, max(bar_idx) FILTER (rn < t1) OVER (PARTITION BY symbol) AS g1, max(bar_idx) FILTER (rn < t2) OVER (PARTITION BY symbol) AS g2 FROM (SELECT symbol, bar_idx, bar_idx AS rn, floor(0.7::DOUBLE * count(*) OVER (PARTITION BY symbol)) AS t1, floor(0.85::DOUBLE * count(*) OVER (PARTITION BY symbol)) AS t2 FROM bars))""")
def _(m):
    from barloom.operators.prepare import embargoed_split
    return embargoed_split(m.bars(), 24)


@query("ml07_balanced_sampling", "symbol:s rows:l positives:l", """SELECT symbol, count(*) AS rows, sum(y) AS positives FROM (SELECT *, sum(y) OVER (PARTITION BY symbol) AS p, row_number() OVER (PARTITION BY symbol, y ORDER BY (bar_idx * 7919) % 10007, bar_idx) AS rn FROM (SELECT *, CASE WHEN close > open * 1.5 THEN 1 ELSE 0 END AS y FROM bars)) WHERE y = 1 OR rn <= 2 * p GROUP BY 1""")
def _(m):
    from barloom.operators.prepare import balanced_sample
    d = m.bars().withColumns({"y": flag(c("close") > c("open") * 1.5), "h": (c("bar_idx") * 7919) % 10007})
    return balanced_sample(d, ["symbol"], "y", ["h", "bar_idx"], 2.0).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"))


@query("ag42_class_balance", "split:s rows:l positives:l imbalance", f"SELECT split, count(*) AS rows, sum(y) AS positives, (count(*) - sum(y)) / sum(y) AS imbalance FROM (SELECT {SPLIT} AS split, CASE WHEN close > open THEN 1 ELSE 0 END AS y FROM bars JOIN bounds USING (symbol)) GROUP BY 1")
def _(m):
    g = _splits(m).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
    return g.withColumn("imbalance", F.when(c("positives") > 0, (c("rows") - c("positives")) / F.when(c("positives") > 0, c("positives"))))


@query("ag43_split_geometry", "symbol:s split:s first_idx:l last_idx:l rows:l", f"SELECT symbol, {SPLIT} AS split, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx, count(*) AS rows FROM bars JOIN bounds USING (symbol) GROUP BY 1, 2")
def _(m):
    return _splits(m).groupBy("symbol", "split").agg(F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx"), F.count(F.lit(1)).alias("rows"))


@query("ml09_gradient_boosted_trees", KEY + "probability")
def _(m):
    from barloom.operators.prepare import train_and_score
    d = blocked(m.bars(), lambda d, w: ff.volatility(ff.price_action(d, w), w).withColumn("label", flag(w.lead("close") > c("close")).cast("double")), before=61, after=1)
    return train_and_score(d.join(bounds(m), "symbol").filter("atr_50 is not null and close_return_10 is not null"), ["close_return_1", "close_return_5", "body_to_range", "atr_ratio_14_50"], "label", "bar_idx < t1")

"""Calendar tables joined to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import clock


def broker_open(bars: DataFrame, hours: str, zone: str = clock.NY) -> DataFrame:
    """Dated broker sessions (``day:start-end,...;day:CLOSED``): covered, and open when covered.

    The schedule text is one configuration value; it becomes a small day-keyed table that is joined on the local date.
    """
    spark = bars.sparkSession
    seg = spark.range(1).select(F.explode(F.split(F.lit(hours), ";")).alias("seg")).select(
        F.to_date(F.split("seg", ":")[0], "yyyyMMdd").alias("day"), F.expr("substring(seg, 10)").alias("body"))
    iv = seg.filter("body <> 'CLOSED'").select("day", F.explode(F.split("body", ",")).alias("iv"))
    at = lambda part: F.to_timestamp(F.concat(F.date_format("day", "yyyyMMdd"), F.split("iv", "-")[part]), "yyyyMMddHHmm")
    iv = iv.select("day", at(0).alias("a"), at(1).alias("b")).withColumn("b", F.when(F.col("b") <= F.col("a"), F.col("b") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("b")))
    days = iv.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"), "a", "b").unionByName(
        seg.filter("body = 'CLOSED'").select("day", F.lit(None).cast("timestamp").alias("a"), F.lit(None).cast("timestamp").alias("b")))
    local = bars.withColumns({"_l": clock.local("ts", zone), "day": F.to_date(clock.local("ts", zone))})
    table = days.groupBy("day").agg(F.collect_list(F.struct("a", "b")).alias("iv"))
    out = local.join(F.broadcast(table), "day", "left")
    hit = F.exists("iv", lambda s: (F.col("_l") >= s["a"]) & (F.col("_l") < s["b"]))
    return out.withColumns({"covered": F.col("iv").isNotNull().cast("int"),
                            "open_flag": F.when(F.col("iv").isNotNull(), F.coalesce(hit, F.lit(False)).cast("int"))}).drop("iv", "_l", "day")


def session_phase(ts: str = "ts") -> Column:
    """1 overnight, 2 first hour, 3 and 4 middle of the day, 5 last ninety minutes of the 09:30-16:00 New York session."""
    m = clock.minute_of_day(clock.local(ts)) - 570
    return (F.when((m < 0) | (m >= 390), 1).when(m < 60, 2).when(m >= 300, 5).when((m >= 150) & (m < 240), 4).otherwise(3))


def _observed(d: Column) -> Column:
    """A fixed holiday moved off the weekend."""
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def equity_holidays(day: Column) -> Column:
    """Is the date a US equity market holiday (rule based, any year)."""
    y = F.year(day)
    fixed = lambda m, d: _observed(F.make_date(y, F.lit(m), F.lit(d)))
    days = [fixed(1, 1), clock.nth_weekday(y, 1, "MON", 3), clock.nth_weekday(y, 2, "MON", 3), F.date_sub(clock.easter(y), 2), clock.last_weekday(y, 5, "MON"),
            fixed(7, 4), clock.nth_weekday(y, 9, "MON", 1), clock.nth_weekday(y, 11, "THU", 4), fixed(12, 25)]
    hit = F.array_contains(F.array(*days), day)
    return hit | ((y >= 2022) & (day == fixed(6, 19)))


def equity_early_close(day: Column) -> Column:
    """13:00 closes: the weekday before Independence Day, the Friday after Thanksgiving, Christmas Eve."""
    y = F.year(day)
    july4, xmas = F.make_date(y, F.lit(7), F.lit(4)), F.make_date(y, F.lit(12), F.lit(24))
    before = (day == F.date_sub(july4, 1)) & F.weekday(july4).between(1, 4)
    black = day == F.date_add(clock.nth_weekday(y, 11, "THU", 4), 1)
    eve = (day == xmas) & (F.weekday(xmas) < 5)
    return (before | black | eve) & ~equity_holidays(day)


def equity_session(bars: DataFrame, ib_minutes: int = 60) -> DataFrame:
    """Session date (rolls at 16:00 New York), regular/overnight/initial-balance flags and minutes to the session edges."""
    t = clock.local("ts")
    m = clock.minute_of_day(t)
    day = F.when(m >= 960, F.date_add(F.to_date(t), 1)).otherwise(F.to_date(t))
    d = bars.withColumns({"session_date": day, "_m": m})
    # the calendar is evaluated once per distinct date, not once per bar
    dates = d.select("session_date").distinct().withColumns({
        "is_holiday": equity_holidays(F.col("session_date")), "is_half_day": equity_early_close(F.col("session_date"))})
    d = d.join(dates, "session_date")
    close = F.when(F.col("is_half_day"), 780).otherwise(960)
    rth = ~F.col("is_holiday") & (F.col("_m") >= 570) & (F.col("_m") < close)
    return d.withColumns({
        "is_rth": rth, "is_overnight": (F.col("_m") >= 960) | (F.col("_m") < 570), "is_ib": rth & (F.col("_m") < 570 + ib_minutes),
        "ib_complete": rth & (F.col("_m") >= 570 + ib_minutes), "minutes_since_open": F.when(rth, F.col("_m") - 570),
        "minutes_until_close": F.when(rth, close - F.col("_m")), "local_minute": F.col("_m"), "local_date": F.to_date(t)}).drop("_m")


def phase_code(d: DataFrame) -> DataFrame:
    """0 closed, 1 overnight, 2 initial balance, 3-5 by minutes since the open and until the close."""
    since, until = F.col("minutes_since_open"), F.col("minutes_until_close")
    code = (F.when(F.col("is_rth") & (until <= 90), 5).when(F.col("is_rth") & (since >= 150) & (since < 240), 4).when(F.col("is_ib"), 2)
            .when(F.col("is_rth"), 3).when(F.col("is_overnight"), 1).otherwise(0))
    return d.withColumn("phase_code", code)


# Release windows in New York minutes (first, last, both inclusive).
MACRO_WINDOWS = {"cpi": (495, 540), "nfp": (495, 540), "fomc": (825, 915), "statement": (835, 850), "presser": (865, 915)}


def payroll_fridays(day: Column) -> Column:
    """First Friday of the month, moved for holidays (to the next Friday on 1-2 January, else to the previous business day)."""
    y, mth = F.year(day), F.month(day)
    first = F.make_date(y, mth, F.lit(1))
    friday = F.next_day(F.date_sub(first, 1), "FRI")
    moved = F.when((mth == 1) & (F.dayofmonth(friday) <= 2), F.date_add(friday, 7)).otherwise(F.date_sub(friday, 1))
    return F.when(equity_holidays(friday), moved).otherwise(friday)


def macro_flags(bars: DataFrame, releases: DataFrame) -> DataFrame:
    """Release windows per bar. ``releases(kind, day)`` lists dated events; payroll dates follow their rule."""
    t = clock.local("ts")
    m, day = clock.minute_of_day(t), F.to_date(t)
    kinds = releases.groupBy("day").agg(F.collect_set("kind").alias("_kinds")).withColumnRenamed("day", "_day")
    d = bars.withColumns({"_day": day, "_m": m}).join(F.broadcast(kinds), "_day", "left")
    out = {}
    for kind, (a, b) in MACRO_WINDOWS.items():
        on = (F.col("_day") == payroll_fridays(F.col("_day"))) if kind == "nfp" else F.coalesce(F.array_contains("_kinds", kind), F.lit(False))
        out[f"{kind}_flag"] = (on & F.col("_m").between(a, b)).cast("int")
    d = d.withColumns(out)
    return d.withColumn("macro_event_flag", F.greatest(*[F.col(k) for k in out])).drop("_day", "_m", "_kinds")

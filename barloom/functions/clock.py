"""Trading clocks and calendars as plain columns. Timestamps are UTC instants; local clocks are derived, never stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NY, LONDON = "America/New_York", "Europe/London"


def local(ts, zone: str = NY) -> Column:
    return F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone)


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def in_clock(t: Column, start_hour: int, end_hour: int, start_minute: int = 0, end_minute: int = 0) -> Column:
    """Half-open wall-clock interval, wrapping midnight when it ends before it starts, empty when both are equal."""
    m, a, b = minute_of_day(t), start_hour * 60 + start_minute, end_hour * 60 + end_minute
    if a == b:
        return F.lit(False)
    return (m >= a) & (m < b) if a < b else (m >= a) | (m < b)


def sessions(ts: str = "ts") -> dict[str, Column]:
    """Session flags and the regime name."""
    ny, ldn = local(ts), local(ts, LONDON)
    asia, london, york = in_clock(ny, 19, 2), in_clock(ldn, 7, 16), in_clock(ny, 8, 17)
    return {
        "in_asian_session": asia.cast("int"), "in_london_session": london.cast("int"), "in_newyork_session": york.cast("int"),
        "in_london_ny_overlap": (london & york).cast("int"),
        "in_london_killzone": in_clock(ny, 2, 5).cast("int"), "in_newyork_killzone": in_clock(ny, 8, 11).cast("int"),
        "session_regime": (F.when(london & york, "overlap").when(york, "new_york").when(london, "london").when(asia, "asia")
                           .otherwise("off_hours")),
    }


def day_close(ts: str = "ts", zone: str = NY, hour: int = 17) -> Column:
    """UTC instant of the market-day close that the bar belongs to."""
    shifted = local(ts, zone) - F.expr(f"INTERVAL {hour} HOURS")
    nxt = F.date_add(F.to_date(shifted), 1).cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    return F.to_utc_timestamp(nxt, zone)


def week_close(ts: str = "ts", zone: str = NY, hour: int = 17) -> Column:
    """UTC instant of the Friday close of the bar's market week."""
    shifted = local(ts, zone) - F.expr(f"INTERVAL {hour} HOURS")
    day = F.date_add(F.to_date(shifted), 1)
    friday = F.next_day(F.date_sub(day, 1), "FRI").cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    return F.to_utc_timestamp(friday, zone)


def fx_open(ts: str = "ts") -> Column:
    """Spot FX trades from after Sunday 17:00 until Friday 17:00 New York."""
    t = local(ts)
    d, m = F.weekday(t), minute_of_day(t)
    return ~((d == 5) | ((d == 6) & (m <= 17 * 60)) | ((d == 4) & (m >= 17 * 60)))


# Dated exchange closures as (New York date, first minute, end minute).
SPECIAL_CLOSURES = [("2026-09-07", 780, 1080)]


def futures_open(ts: str = "ts") -> Column:
    """Index futures trade Sunday 18:00 to Friday 17:00 New York with a daily 17:00-18:00 halt."""
    t = local(ts)
    d, m = F.weekday(t), minute_of_day(t)
    shut = F.lit(False)
    for day, a, b in SPECIAL_CLOSURES:
        shut = shut | ((F.to_date(t) == F.lit(day).cast("date")) & (m >= a) & (m < b))
    return (F.when(shut | (d == 5), False).when(d == 6, m >= 18 * 60).when(d == 4, m < 17 * 60)
            .otherwise((m < 17 * 60) | (m >= 18 * 60)))


def floor_to(ts, seconds: int) -> Column:
    x = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_timestamp(x) / seconds) * seconds)


def third_friday(d: Column) -> Column:
    first = F.trunc(d, "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)


def last_business_day_of_quarter(d: Column) -> Column:
    end = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def easter(year: Column) -> Column:
    """Western Easter by the Gregorian computus, on the golden number and century corrections."""
    def fdiv(a, b):
        return F.floor(a / b)
    golden, century = F.pmod(year, F.lit(19)), fdiv(year, 100)
    epact = F.pmod(19 * golden + century - fdiv(century, 4) - fdiv(8 * century + 13, 25) + 15, F.lit(30))
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    # days after 21 March of the full moon, then on to the next Sunday
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.next_day(full, "SUN")

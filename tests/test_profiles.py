"""Session tables, first touches and profile setups on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import profiles as pf

DAY = dt.date(2024, 1, 3)


def bars(spark, rows):
    """rows: (minutes since the open, open, high, low, close)."""
    start = dt.datetime(2024, 1, 3, 14, 30)
    data = [("x", i, start + dt.timedelta(minutes=m), o, h, lo, c, 1.0, DAY, True, m < 60, m) for i, (m, o, h, lo, c) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, bar_idx long, ts timestamp, open double, high double, low double, close double, atr_14 double, session_date date, is_rth boolean, is_ib boolean, minutes_since_open int")


def test_open_drive_needs_six_rising_bars(spark):
    up = [(5 * i, 10.0 + i, 11.5 + i, 10.0 + i, 11.0 + i) for i in range(8)]
    drive = lambda rows: pf.session_table(bars(spark, rows)).first().open_drive
    assert drive(up) == 1
    assert drive([*up[:3], (15, 13.0, 14.0, 10.0, 12.5), *up[4:]]) == 0  # one close falls
    assert drive([up[0], *up[4:]]) is None  # too few bars in the first half hour
    assert drive([(5 * i, 20.0 - i, 20.0 - i, 18.5 - i, 19.0 - i) for i in range(8)]) == 1


def test_day_types(spark):
    def kind(high, low, close, shape="D", vah=12.0, val=9.0):
        s = spark.createDataFrame([("x", DAY, 10.0, close, high, low, 11.0, 9.0)], "symbol string, session_date date, rth_open double, rth_close double, rth_high double, rth_low double, ib_high double, ib_low double")
        return pf.day_types(s, spark.createDataFrame([("x", DAY, vah, val, shape)], "symbol string, session_date date, vah double, val double, shape string")).first().day_type
    assert kind(11.0, 9.0, 10.0) == 1
    assert kind(11.8, 9.0, 10.0) == 2
    assert kind(13.5, 9.0, 13.4) == 3
    assert kind(13.5, 9.0, 13.4, "P") == 4
    assert kind(13.5, 8.0, 10.0) == 5
    assert kind(10.0, 10.0, 10.0) == 0


def test_first_touch_looks_at_bars_not_only_at_ranges(spark):
    b = spark.createDataFrame([("x", i, lo, hi) for i, (lo, hi) in enumerate([(1.0, 2.0), (5.0, 6.0), (1.0, 2.0), (3.0, 4.0)])], "symbol string, bar_idx long, low double, high double")
    lv = spark.createDataFrame([("x", 3.5, 0), ("x", 2.5, 0), ("x", 1.5, 1), ("x", 1.5, 3)], "symbol string, price double, born_idx long")
    got = {(r.price, r.born_idx): r.dead_idx for r in pf.first_touch(lv, b).collect()}
    assert got == {(3.5, 0): 3, (2.5, 0): None, (1.5, 1): 2, (1.5, 3): None}


def setup_bars(spark, rows):
    base = {"close": 10.0, "high": 10.5, "low": 9.5, "atr_14": 1.0, "dist_vah_atr": 3.0, "dist_val_atr": 3.0, "volume_zscore_50": 0.0, "open_drive_flag": 0, "profile_shape": 1, "open_type": 1, "in_va": 1, "above_vah": 0, "below_val": 0,
            "displacement_bullish": 0, "displacement_bearish": 0, "bars_since_sweep_high": 9, "bars_since_sweep_low": 9, "dist_nearest_lvn_atr": 9.0, "hvn_above_close": 9.0, "hvn_below_close": 9.0}
    data = [("x", i, day, *((base | r)[k] for k in base)) for i, (day, r) in enumerate(rows)]
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in base.items())
    return spark.createDataFrame(data, f"symbol string, bar_idx long, session_date int, {kinds}")


def test_setups_fire_on_rising_edges_and_restart_with_the_session(spark):
    lvn = {"dist_nearest_lvn_atr": 0.1, "displacement_bullish": 1}
    breakout = {"volume_zscore_50": 3.0, "displacement_bullish": 1, "above_vah": 1, "in_va": 0, "dist_vah_atr": -0.5, "close": 10.5, "high": 10.5, "low": 9.5}
    retest = {"dist_vah_atr": 0.0, "low": 9.9}
    rows = [(1, lvn), (1, lvn), (2, lvn), (2, {}), (2, breakout), (2, retest), (3, retest)]
    got = [(r.setup_type, r.setup_side) for r in pf.setups(setup_bars(spark, rows)).orderBy("bar_idx").collect()]
    assert got == [(5, 1), (0, 0), (5, 1), (0, 0), (3, 1), (2, 1), (0, 0)]


def test_failed_auction_counts_bars_outside(spark):
    out = {"above_vah": 1, "in_va": 0, "dist_vah_atr": -0.2}
    back = {"dist_vah_atr": 0.2, "bars_since_sweep_high": 1}
    rows = [(1, out), (1, out), (1, back), (1, {}), *[(2, out)] * 4, (2, back)]
    got = [(r.setup_type, r.setup_side, r.failed_auction_with_sweep) for r in pf.setups(setup_bars(spark, rows)).orderBy("bar_idx").collect()]
    assert got[2] == (4, -1, 1) and all(g[0] == 0 for i, g in enumerate(got) if i != 2)  # four bars outside are too many

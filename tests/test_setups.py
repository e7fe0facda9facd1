"""Admission of structure setups on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import setups as su

NAMES = {n: (p, gap, lane) for n, _, p, gap, lane in su.SETUPS}


def frame(spark, rows):
    """rows: (bar, session day, {setup: (side, key)}); one symbol."""
    fields = "struct<side:int,confidence:double,key:long>"
    data = [("x", bar, dt.date(2024, 1, 1) + dt.timedelta(days=day), *((c[n][0], 0.5, c[n][1] << 12) if n in c else None for n in NAMES)) for bar, day, c in rows]
    return spark.createDataFrame(data, "symbol string, bar_idx long, session_date date, " + ", ".join(f"cand_{n} {fields}" for n in NAMES))


def plain(rows):
    out, before, last, count = [], {}, {}, {}
    for bar, day, cands in rows:
        for lane in ("primary", "research"):
            mine = sorted((NAMES[n][0], n, *c) for n, c in cands.items() if NAMES[n][2] == lane)
            old = before.get(lane, (None, set()))
            active = old[1] if old[0] == bar - 1 else set()
            for _, n, side, key in mine:
                fits = key not in active and bar - last.get((lane, key), -10 ** 9) >= NAMES[n][1] and count.get((lane, day, side), 0) < su.MOST_PER_SIDE
                if fits:
                    out.append((bar, lane, n, side))
                    last[lane, key] = bar
                    count[lane, day, side] = count.get((lane, day, side), 0) + 1
                    break
            before[lane] = (bar, {key for *_, key in mine})
    return sorted(out)


def fired(spark, rows, size=4096):
    return sorted((r.bar_idx, r.lane, r.setup_type, r.side) for r in su.admitted(frame(spark, rows), size).collect())


def test_priority_activity_spacing_and_side_limit(spark):
    rows = [(0, 0, {"sweep_reclaim": (1, 1), "ifvg_reversal": (1, 2)}), (1, 0, {"ifvg_reversal": (1, 2)}),  # active since bar 0
            (2, 0, {}), (3, 0, {"ifvg_reversal": (1, 2)}),  # within 8 bars of its fire
            (4, 0, {"sweep_reclaim": (1, 3)}), (5, 0, {}), (6, 0, {"sweep_reclaim": (1, 4)}), (7, 0, {}),
            (8, 0, {"sweep_reclaim": (1, 5), "classic_breaker": (1, 6)}),  # fourth long of the session; the research lane counts alone
            (9, 0, {"sweep_reclaim": (-1, 7)}), (10, 1, {"sweep_reclaim": (1, 8)})]
    want = [(0, "primary", "ifvg_reversal", 1), (4, "primary", "sweep_reclaim", 1), (6, "primary", "sweep_reclaim", 1), (8, "research", "classic_breaker", 1), (9, "primary", "sweep_reclaim", -1), (10, "primary", "sweep_reclaim", 1)]
    assert plain(rows) == want
    assert fired(spark, rows) == want
    assert fired(spark, rows[:0]) == []


@pytest.mark.parametrize("size", [23, 4096])
def test_admission_does_not_depend_on_blocks(spark, size):
    import random
    rng = random.Random(3)
    rows = [(i, i // 40, {n: (rng.choice([1, -1]), 100 * NAMES[n][0] + rng.randrange(3)) for n in NAMES if rng.random() < 0.2}) for i in range(200)]
    assert fired(spark, rows, size) == plain(rows)

"""Zigzag swings on small cases and over block sizes."""

import random

from barloom.operators import swings as sw


def walk(rows, warmup=5, confirm=1.5, least_size=1.5, least_distance=1.0, apart=3):
    """Plain walk over (high, low, close, atr), as the rule reads."""
    n = len(rows)
    start = next((i for i in range(warmup, n) if rows[i][3] and rows[i][3] > 0), n)
    if n < warmup + 20 or start >= n - sw.LEAST_AFTER:
        return []
    first = range(start, min(n, start + sw.INIT))
    hi, lo = max(first, key=lambda i: (rows[i][0], -i)), min(first, key=lambda i: (rows[i][1], i))
    up = not hi < lo
    top, bottom = hi, lo
    last, last_i, out = rows[lo][1] if up else rows[hi][0], -apart - 1, []
    for i in range(max(hi, lo) + 1, n):
        high, low, close, a = rows[i]
        if not a or a <= 0:
            continue
        if up and high > rows[top][0]:
            top = i
        if not up and low < rows[bottom][1]:
            bottom = i
        at = top if up else bottom
        price = rows[at][0] if up else rows[at][1]
        if ((price - close) if up else (close - price)) < confirm * a or i <= at:
            continue
        atr = rows[at][3] or a
        if at - last_i >= apart and abs(price - last) >= least_distance * a and abs(price - last) / atr >= least_size:
            out.append((i, -1 if up else 1, at, price))
            last, last_i = price, at
        up = not up
        if up:
            top = i
        else:
            bottom = i
    return out


def run(spark, rows, **kw):
    d = spark.createDataFrame([("x", i, *map(float, r[:3]), None if r[3] is None else float(r[3])) for i, r in enumerate(rows)], "symbol string, bar_idx long, high double, low double, close double, atr_14 double")
    got = sw.zigzag(d, warmup=5, **kw).select("confirm_idx", "swing_side", "swing_idx", "swing_price").collect()
    return sorted(map(tuple, got))


def test_provisional_pivot_moves_until_it_is_confirmed(spark):
    path = [10] * 4 + [10.5] + [10] * 60 + [9, 8, 7, 9, 11, 13, 15, 17, 19, 21, 20.5, 22, 24, 23.5, 20, 18, 15, 12, 9, 6, 8, 11, 14, 17, 20, 23]
    rows = [(p + 0.2, p - 0.2, p, 1.0) for p in path]
    want = walk(rows)
    assert run(spark, rows) == want
    high = next(w for w in want if w[1] == -1 and w[2] > 15)
    assert rows[high[2]][0] == 24.2 and high[0] > high[2]  # the pivot moved from 21.2 to 24.2; it is known later than it was formed


def test_walk_does_not_depend_on_blocks(spark):
    rng = random.Random(7)
    p, rows = 100.0, []
    for i in range(400):
        p += rng.gauss(0, 1)
        rows.append((p + rng.random(), p - rng.random(), p, None if i < 9 else 1 + rng.random()))
    want = walk(rows)
    assert len(want) > 20
    for size in (70, 4096):
        assert run(spark, rows, size=size) == want


def test_short_histories_have_no_swings(spark):
    assert run(spark, [(1.0, 0.5, 0.7, 1.0)] * 12) == []

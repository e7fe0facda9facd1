"""Block partitioning must not change results: small blocks equal one block, and appended bars never rewrite the past."""

from pyspark.sql import functions as F

from barloom.operators import features as ff
from barloom.operators.blocks import blocked, carry_last, chained, kernel, number_rows, running, weekly_spread
from barloom.operators.relate import asof
from barloom.operators.recursive import smooth, SMOOTH


def series(spark, n=700, seed=3, symbols=2):
    d = spark.range(n * symbols).select(
        F.when(F.col("id") % symbols == 0, "A").otherwise("B").alias("symbol"), F.floor(F.col("id") / symbols).alias("k"))
    h = lambda s: (F.abs(F.xxhash64("symbol", "k", F.lit(s))) % 1000) / 1000.0
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 3600 + F.when(F.col("k") % 50 > 45, 1800).otherwise(0)))
    d = d.withColumns({"open": 100 + h(seed), "close": 100 + h(seed + 1), "volume": F.floor(h(seed + 2) * 9) + 1.0})
    return d.withColumns({"high": F.greatest("open", "close") + h(seed + 3), "low": F.least("open", "close") - h(seed + 4)}).drop("k")


def rows(df, cols):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("symbol", "bar_idx", *cols).collect())


def test_numbering_is_dense_and_ordered(spark):
    b = number_rows(series(spark), span_seconds=37 * 3600)
    got = sorted((r.symbol, r.ts, r.bar_idx) for r in b.collect())
    for s in ("A", "B"):
        assert [i for sym, _, i in got if sym == s] == list(range(700))


def test_small_blocks_equal_one_block(spark):
    b = number_rows(series(spark)).cache()
    cols = ["atr_50", "rolling_vol_60", "donchian_width_20"]
    assert rows(blocked(b, ff.volatility, before=61, size=64), cols) == rows(blocked(b, ff.volatility, before=61, size=10 ** 6), cols)
    cols = ["raw_swing_high", "raw_swing_low"]
    assert rows(blocked(b, ff.swings, before=6, after=3, size=50), cols) == rows(blocked(b, ff.swings, before=6, after=3, size=10 ** 6), cols)


def test_future_bars_do_not_change_the_past(spark):
    b = number_rows(series(spark)).cache()
    cut = b.filter("bar_idx < 400")
    cols = ["prior_high_20", "sweep_high_20", "bars_since_sweep_high"]
    f = lambda d: ff.structure_ages(blocked(d, lambda r, w: ff.structure(ff.volatility(r, w), w), before=122, size=90), 90)
    full = [r for r in rows(f(b), cols) if r[1] < 400]
    assert full == rows(f(cut), cols)


def test_prefix_scans_match_whole_history(spark):
    b = number_rows(series(spark)).cache()
    got = running(carry_last(b, {"l": F.when(F.col("volume") > 8, F.col("close"))}, size=31), sums={"s": F.col("volume")}, maxs={"m": F.col("high")}, size=31)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r.symbol, r.bar_idx)):
        last, tot, top = seen.get(r.symbol, (None, 0.0, -1e9))
        last = r.close if r.volume > 8 else last
        tot, top = tot + r.volume, max(top, r.high)
        seen[r.symbol] = (last, tot, top)
        assert (r.l, round(r.s, 6), r.m) == (last, round(tot, 6), top)


def test_weekly_blocks_hold_their_warmup(spark):
    b = number_rows(series(spark)).cache()
    rows_ = weekly_spread(b, warmup=50, weeks=1).collect()
    own = [(r.symbol, r.bar_idx) for r in rows_ if r.own]
    assert len(own) == len(set(own)) == 1400
    for key in {(r.symbol, r.block) for r in rows_}:
        mine = sorted(r.bar_idx for r in rows_ if (r.symbol, r.block) == key and r.own)
        halo = sorted(r.bar_idx for r in rows_ if (r.symbol, r.block) == key and not r.own)
        if mine:
            assert halo == list(range(max(0, mine[0] - 50), mine[0]))


def test_kernel_converges_to_whole_history(spark):
    b = number_rows(series(spark)).cache()
    a = rows(kernel(b, smooth, SMOOTH, ["close"], warmup=250, weeks=1), ["ema_8", "ema_21"])
    z = rows(kernel(b, smooth, SMOOTH, ["close"], warmup=5000, weeks=1), ["ema_8", "ema_21"])
    assert len(a) == len(z) and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-9 and abs(x[3] - y[3]) < 1e-6 for x, y in zip(a, z))


def test_asof_across_chunks(spark):
    b = number_rows(series(spark)).cache()
    right = b.filter("bar_idx % 90 = 5").select("symbol", F.col("ts").alias("rts"), F.col("bar_idx").alias("ri"))
    for strict in (False, True):
        got = asof(b, right, "ts", "rts", ["ri"], span_seconds=3600 * 20, strict=strict).collect()
        for r in got:
            lim = r.bar_idx - 1 if strict else r.bar_idx
            want = (lim - 5) // 90 * 90 + 5 if lim >= 5 else None
            assert r.ri == want


SIZES = (64, 500, 10 ** 6)


def same_for_all_sizes(f, cols):
    first, *others = [rows(f(size), cols) for size in SIZES]
    assert any(v is not None for r in first for v in r[2:])
    assert all(o == first for o in others)


def test_core_families_do_not_depend_on_blocks(spark):
    b = number_rows(series(spark)).cache()
    same_for_all_sizes(lambda n: ff.core(b, (ff.exhaustion,), size=n), ["bars_since_sweep_high", "latest_swing_low", "bars_since_bullish_divergence", "bullish_divergence_strength"])
    same_for_all_sizes(lambda n: ff.core(b, (ff.session, ff.temporal), size=n), ["bars_since_last_sweep", "bars_since_last_displacement", "bull_sequence_sweep_displacement", "major_event_density_25"])
    same_for_all_sizes(lambda n: ff.core(b, (ff.pullback,), size=n), ["continuation_bars_since_bull_impulse", "continuation_bull_pullback_depth_atr", "continuation_bars_since_bear_resume"])


def test_rare_events_keep_their_age(spark):
    b = number_rows(series(spark)).cache()
    far = rows(ff.ages(b, {"age": F.col("bar_idx") == 3}, 64), ["age"])
    assert all(r[2] == (None if r[1] < 3 else r[1] - 3) for r in far)


def test_state_machines_run_through_all_blocks(spark):
    from barloom.operators import patterns as pt
    b = number_rows(series(spark)).cache()
    d = pt.with_swings(b).withColumns({"since_sell_sweep": F.col("bar_idx") % 7, "since_buy_sweep": F.col("bar_idx") % 5}).cache()
    same_for_all_sizes(lambda n: pt.structure_breaks(d, n), ["break_kind", "structure_state", "structure_break_level"])
    once = b.withColumn("jump", F.when(F.col("bar_idx") == 10, 1.0).otherwise(0.0))
    hold = chained(once, lambda p, s: ({"on": [1 if x else 0 for x in (p["jump"].cumsum() + s[0])]}, [s[0] + p["jump"].sum()]), [0.0], "on int", ["jump"], size=64)
    assert all(r[2] == int(r[1] >= 10) for r in rows(hold, ["on"]))


def test_phase_statistics_reach_rare_phases(spark):
    from barloom.operators import patterns as pt
    b = blocked(number_rows(series(spark)), ff.volatility, before=61).withColumn("phase_code", F.when(F.col("bar_idx") % 29 == 0, 1).otherwise(0)).cache()
    same_for_all_sizes(lambda n: pt.displacement(b, n), ["volume_phase_z", "volume_phase_rel", "disp_score"])


def test_ranking_compares_scores_in_full(spark):
    from barloom.operators.metrics import ranking
    d = spark.range(2000).select(F.lit("m").alias("model_id"), (0.5 + F.col("id") * 1e-9).alias("probability"), F.when(F.col("id") >= 1000, 1).otherwise(0).alias("target"))
    for size in (64, 500, 4096):
        r = ranking(d, size=size).first()
        assert (r.average_precision, r.roc_auc) == (1.0, 1.0)


def test_trades_that_start_together_are_admitted_once(spark):
    from barloom.operators.labels import admit
    t = spark.createDataFrame([("A", 1, 10, "x"), ("A", 1, 5, "y"), ("A", 7, 9, "z"), ("B", 1, 3, "x")], "symbol string, bar_idx long, exit_idx long, family string")
    got = sorted((r.symbol, r.bar_idx, r.exit_idx) for r in admit(t).filter("admitted = 1").collect())
    assert got == [("A", 1, 5), ("A", 7, 9), ("B", 1, 3)]


def test_folds_cover_the_table(spark):
    from barloom.operators.prepare import walk_forward
    for n in (100, 13_000):
        f = walk_forward(spark.range(n).withColumnRenamed("id", "bar_idx"), 0.3, 5, 4)
        val = sorted(r.bar_idx for r in f.filter("role = 'val'").collect())
        assert val == list(range(int(n * 0.3), n))


def test_greedy_rules_run_through_all_blocks(spark):
    from barloom.operators.labels import admit, cooldown
    import random
    rng = random.Random(4)
    at = sorted(rng.sample(range(2000), 600))
    ev = spark.createDataFrame([("A", i) for i in at], "symbol string, bar_idx long").cache()
    tr = spark.createDataFrame([("A", i, i + 1 + i % 17) for i in at], "symbol string, bar_idx long, exit_idx long").cache()
    kept, last = [], -99
    taken, free = [], -1
    for i in at:
        if i - last > 5:
            kept.append(i)
            last = i
        if i > free:
            taken.append(i)
            free = i + 1 + i % 17
    assert sorted(r.bar_idx for r in cooldown(ev, 5).filter("accepted = 1").collect()) == kept
    assert sorted(r.bar_idx for r in admit(tr).filter("admitted = 1").collect()) == taken


def test_greedy_rounds_grow_with_the_logarithm(spark, monkeypatch):
    from barloom.operators import blocks
    from barloom.operators.labels import cooldown
    tables = []
    real = blocks.saved
    monkeypatch.setattr(blocks, "saved", lambda df, name="step": tables.append(name) or real(df, name))
    for n, most in ((60, 8), (3000, 13)):  # an event on every bar: accepted events are n / 3
        tables.clear()
        ev = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("bar_idx"))
        assert [r.bar_idx for r in cooldown(ev, 2).filter("accepted = 1").orderBy("bar_idx").collect()] == list(range(0, n, 3))
        assert tables.count("hops") <= most


def test_state_passes_over_blocks_without_rows(spark):
    d = spark.createDataFrame([("A", i, 1.0) for i in (0, 1, 500, 501, 900)], "symbol string, bar_idx long, x double")
    got = chained(d, lambda p, s: ({"total": p["x"].cumsum() + s[0]}, [s[0] + p["x"].sum()]), [0.0], "total double", ["x"], size=10)
    assert {r.bar_idx: r.total for r in got.collect()} == {0: 1.0, 1: 2.0, 500: 3.0, 501: 4.0, 900: 5.0}

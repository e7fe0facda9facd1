"""Shadow policy: isolated three-valued checks and the hypothetical state."""

import random

import numpy as np

from barloom.operators import shadow as sh

FIELDS = "model_id string, symbol string, bar_idx long, probability double, stress_regime string, session_regime string, composite_regime string, expected_move double, matched boolean, observed boolean"
P = sh.Policy("m", 0.5, ("high",), ("asia",), (), (("up", "london"),), (), 2.0, None, 3, (("london", 1.0), ("asia", 1.0)))


def run(spark, rows, policy=P, size=4096):
    d = spark.createDataFrame([("m", "x", i, *r) for i, r in enumerate(rows)], FIELDS)
    return sh.evaluate(d, (policy,), size=size).orderBy("bar_idx").collect()


def test_checks_are_isolated_and_fail_closed(spark):
    good = (0.9, "calm", "london", "flat", 5.0, True, True)
    rows = [good, (0.9, "high", "asia", "up", 0.1, True, True), (0.9, None, None, None, None, True, True), (0.9, "calm", "off", "flat", 5.0, True, True), (None, "calm", "london", "flat", 5.0, True, True)]
    got = run(spark, rows)
    assert got[0].eligible == 1 and got[0].reasons == ""
    assert [got[1][f"check_{n}"] for n in sh.CHECKS] == ["rejected", "rejected", "disabled", "passed", "disabled", "rejected", "disabled", "rejected"]
    assert [got[2][f"check_{n}"] for n in sh.CHECKS] == ["unverified", "unverified", "disabled", "unverified", "disabled", "unverified", "disabled", "rejected"]
    assert got[3].check_expected_move == "unverified" and got[3].eligible == 0  # no spread is known there
    assert got[4].candidate == 0 and got[4].eligible == 0


def test_only_verified_matches_move_the_state(spark):
    row = lambda matched, observed=True: (0.9, "calm", "london", "flat", 5.0, matched, observed)
    got = run(spark, [row(False), row(True, False), row(None), row(True), row(True), row(True), row(True), row(True)])
    assert [r.eligible for r in got] == [0, 0, 0, 1, 0, 0, 0, 1]
    assert [r.last_before for r in got] == [None, None, None, None, 3, 3, 3, 3]


def test_walk_equals_plain_rules_over_blocks(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 3), "calm", "london", "flat", rng.choice([5.0, 0.5]), rng.random() < 0.7, True) for _ in range(150)]
    p = sh.Policy("m", 0.3, least_move_to_spread=2.0, least_quantile=0.3, cooldown=2, spreads=(("london", 1.0),))
    last, seen, want = None, [], []
    for i, (prob, *_, move, matched, _o) in enumerate(rows):
        candidate = prob >= 0.3 and matched
        ok = candidate and move >= 2.0 and not (seen and prob <= np.quantile([*seen, prob], 0.3)) and not (last is not None and i - last <= 2)
        want.append(int(ok))
        if candidate:
            seen = [*seen, prob][-sh.HISTORY:]
        last = i if ok else last
    assert sum(want) > 10
    for size in (60, 4096):
        assert [r.eligible for r in run(spark, rows, p, size)] == want

"""Event matching, fingerprints, all-pairs correlations and greedy pruning against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics as mt
from barloom.operators import prune as pn


def plain_events(rows, threshold, cooldown, tolerance):
    zones, start, before = [], None, None
    for i, y, _ in rows:
        if y and start is not None and i != before + 1:
            zones.append((start, before))
            start = i
        elif y and start is None:
            start = i
        elif not y and start is not None:
            zones.append((start, before))
            start = None
        before = i
    if start is not None:
        zones.append((start, before))
    events = []
    for i, _, p in rows:
        if p >= threshold and (not events or i - events[-1] > cooldown):
            events.append(i)
    used, hits = set(), 0
    for e in events:
        free = [k for k, (a, b) in enumerate(zones) if k not in used and a - tolerance <= e <= b + tolerance]
        if free:
            used.add(free[0])
            hits += 1
    return len(events), len(zones), hits


def test_events_match_zones_once_in_order(spark):
    rng = random.Random(5)
    for share, tolerance in ((0.5, 2), (0.1, 6), (0.9, 0)):
        at = sorted(rng.sample(range(600), 400))
        rows = [(i, int(rng.random() < share), rng.random()) for i in at]
        d = spark.createDataFrame([("m", "x", *r) for r in rows], "model_id string, symbol string, bar_idx long, target int, probability double")
        got = {r.threshold: (r.events, r.zones, r.matched) for r in mt.event_metrics(d, [0.3, 0.8, 2.0], 2, tolerance).collect()}
        assert got == {t: plain_events(rows, t, 2, tolerance) for t in (0.3, 0.8, 2.0)}


def table(spark, n=500):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=n), rng.normal(size=n)
    cols = {"a": a, "b": b, "a2": a.copy(), "near": a + 1e-3 * rng.normal(size=n), "flat": np.full(n, 3.0), "small": 1e-6 * b, "mix": a + b}
    y = (a + 0.2 * rng.normal(size=n) > 0).astype(float)
    rows = [(i, *(float(v[i]) for v in cols.values()), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols) + ", label double"), cols, y


def test_gram_gives_all_correlations(spark):
    d, cols, y = table(spark)
    names = ["a", "b", "near", "mix", "label"]
    got, n = pn.gram(d.repartition(7), names)
    assert n == 500 and np.allclose(got, np.corrcoef(np.stack([*(cols[x] for x in names[:-1]), y])), atol=1e-12)


def test_pruning_keeps_one_of_each(spark):
    d, _, _ = table(spark)
    columns = ["a", "b", "a2", "near", "flat", "small", "mix"]
    got = {r.column_name: (r.reason, r.kept_column) for r in pn.prune(d, columns, "label", ["k"]).collect()}
    assert got["flat"] == ("constant", None) and got["a2"] == ("duplicate", "a") and got["small"] == ("low_variance", None)
    assert {got["a"], got["near"]} in ({("kept", None), ("collinear", "a")}, {("kept", None), ("collinear", "near")})
    assert got["b"] == got["mix"] == ("kept", None)


def test_greedy_drop_takes_the_closest_pair_first_and_later_names():
    corr = np.array([[1, 0.99, 0.985], [0.99, 1, 0.999], [0.985, 0.999, 1]])
    assert pn.greedy_drop(["x", "y", "z"], corr, {"x": 0.1, "y": 0.1, "z": 0.1}, 0.98) == [("z", "y", 0.999), ("y", "x", 0.99)]
    assert pn.greedy_drop(["x", "y", "z"], corr, {"x": 0.1, "y": 0.2, "z": 0.3}, 0.98) == [("y", "z", 0.999), ("x", "z", 0.985)]


def test_fingerprints_follow_keys_not_rows(spark):
    d = spark.createDataFrame([(i, float(i % 5), float(i % 5), float((i + 1) % 5)) for i in range(100)], "k long, u double, v double, w double")
    m = pn.fingerprints(d.orderBy(F.rand(3)), ["u", "v", "w"], ["k"])
    assert m["u"][:6] == m["v"][:6] and m["u"][:6] != m["w"][:6]


@pytest.mark.parametrize("names", [["a"], []])
def test_empty_tables(spark, names):
    d = spark.createDataFrame([], "k long, a double, label double")
    assert [r.reason for r in pn.prune(d, names, "label", ["k"]).collect()] == ["constant"] * len(names)

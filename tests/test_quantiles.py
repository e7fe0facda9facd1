"""Exact quantiles, archive restore and early closes on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.calendars import equity_early_close
from barloom.operators.quantiles import quantiles
from barloom.sources.files import restore


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"ties": np.repeat([1.0, 2.0, 2.0, 7.0], 50), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "wide": np.concatenate([rng.normal(size=300), [1e12, -1e9, 1e-9]]), "same": np.full(20, 4.0)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    probs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = {r.g: [r[n] for n in probs] for r in quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], {n: (F.col("x"), p) for n, p in probs.items()}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, list(probs.values())), rtol=1e-12, atol=0)
    assert quantiles(spark.createDataFrame([], "x double"), [], {"m": (F.col("x"), 0.5)}).collect()[0].m is None


def test_restore_strategies(spark):
    now, old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double"), spark.createDataFrame([(2, 9.0), (3, 9.0)], "k long, v double")
    values = lambda d: sorted(tuple(r) for r in d.collect())
    assert values(restore(now, old, ["k"], "ignore")) == [(1, 1.0), (2, 2.0), (3, 9.0)]
    assert values(restore(now, old, ["k"], "replace")) == [(1, 1.0), (2, 9.0), (3, 9.0)]
    assert values(restore(now, old.filter("k = 3"), ["k"], "abort")) == [(1, 1.0), (2, 2.0), (3, 9.0)]
    with pytest.raises(ValueError):
        restore(now, old, ["k"], "abort")


def test_early_closes(spark):
    days = [dt.date(2023, 11, 24), dt.date(2024, 11, 29), dt.date(2024, 7, 3), dt.date(2024, 12, 24), dt.date(2024, 11, 22), dt.date(2023, 12, 24), dt.date(2024, 11, 28)]
    got = {r.d: r.e for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", equity_early_close(F.col("d")).alias("e")).collect()}
    assert [got[d] for d in days] == [True, True, True, True, False, False, False]

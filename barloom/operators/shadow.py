"""Shadow policy: every exclusion judged on its own, failing closed, with a hypothetical state that only verified matches move."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import c
from barloom.operators.blocks import BLOCK_ROWS, chained

HISTORY = 64  #: candidate probabilities that the quantile looks back on
CHECKS = ("stress", "session", "composite", "composite_session", "composite_stress", "expected_move", "quantile", "cooldown")
_NAMES = {0: "passed", 1: "rejected", 2: "disabled", 3: "unverified"}


@dataclass(frozen=True)
class Policy:
    """What one model abstains from; an empty or None setting disables its check."""

    model_id: str
    threshold: float
    high_stress: tuple[str, ...] = ()
    sessions: tuple[str, ...] = ()
    composites: tuple[str, ...] = ()
    composite_sessions: tuple[tuple[str, str], ...] = ()
    composite_stress: tuple[tuple[str, str], ...] = ()
    least_move_to_spread: float | None = None
    least_quantile: float | None = None
    cooldown: int | None = None
    spreads: tuple[tuple[str, float], ...] = field(default_factory=tuple)


def status(enabled: bool, inputs: list[Column], rejected: Column) -> Column:
    """disabled, unverified where an input is missing, rejected or passed."""
    if not enabled:
        return F.lit("disabled")
    known = F.lit(True)
    for x in inputs:
        known = known & x.isNotNull()
    return F.when(~known, "unverified").when(F.coalesce(rejected, F.lit(True)), "rejected").otherwise("passed")


def _pairs(a: Column, b: Column, pairs) -> Column:
    out = F.lit(False)
    for x, y in pairs:
        out = out | ((a == x) & (b == y))
    return out


def static_checks(d: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """``d`` (model_id, probability, stress_regime, session_regime, composite_regime, expected_move) with the checks that need no state, and the threshold."""
    s, g, k, mv = c("stress_regime"), c("session_regime"), c("composite_regime"), c("expected_move")
    cols = {f"check_{n}": F.lit(None).cast("string") for n in CHECKS[:6]} | {"crossed": F.lit(False), "_q": F.lit(None).cast("double"), "_cool": F.lit(None).cast("double")}
    for p in policies:
        mine = c("model_id") == p.model_id
        spread = F.create_map(*(F.lit(x) for kv in p.spreads for x in kv))[g] if p.spreads else F.lit(None).cast("double")
        new = {"check_stress": status(bool(p.high_stress), [s], s.isin(*p.high_stress)), "check_session": status(bool(p.sessions), [g], g.isin(*p.sessions)), "check_composite": status(bool(p.composites), [k], k.isin(*p.composites)),
               "check_composite_session": status(bool(p.composite_sessions), [k, g], _pairs(k, g, p.composite_sessions)), "check_composite_stress": status(bool(p.composite_stress), [k, s], _pairs(k, s, p.composite_stress)),
               "check_expected_move": status(p.least_move_to_spread is not None, [mv, g, spread], mv < (p.least_move_to_spread or 0.0) * spread),
               "crossed": F.coalesce(c("probability").between(0.0, 1.0) & (c("probability") >= p.threshold), F.lit(False)), "_q": F.lit(p.least_quantile).cast("double"), "_cool": F.lit(p.cooldown).cast("double")}
        cols = {n: F.when(mine, x).otherwise(cols[n]) for n, x in new.items()}
    return d.withColumns(cols)


def _walk(p, state):
    """The state is the last emitted bar and the last candidates' probabilities. A row is judged before it changes the state."""
    last, *seen = state
    out = {"q": [], "cool": [], "eligible": [], "before": []}
    for bar, prob, q, cool, candidate, clean in zip(*(p[x].tolist() for x in ("bar_idx", "probability", "_q", "_cool", "candidate", "_clean"))):
        out["before"].append(last)
        known = prob is not None and prob == prob
        a = 2 if q is None or q != q else 3 if not known else int(bool(seen) and prob <= float(np.quantile([*seen, prob], q)))
        b = 2 if cool is None or cool != cool else int(last == last and bar - last <= cool)
        ok = bool(candidate) and bool(clean) and a in (0, 2) and b in (0, 2)
        out["q"].append(a)
        out["cool"].append(b)
        out["eligible"].append(int(ok))
        if candidate:
            seen = [*seen, prob][-HISTORY:]
        if ok:
            last = float(bar)
    return out, [last, *seen]


def evaluate(d: DataFrame, policies: tuple[Policy, ...], keys: tuple[str, ...] = ("model_id", "symbol"), size: int = BLOCK_ROWS) -> DataFrame:
    """``d`` (with matched: a verified setup of the same bar and side, and observed: the observation holds) with ``check_<name>`` for all of ``CHECKS``,
    candidate, eligible and the hypothetical last emitted bar before the row.

    A check that lacks an input is unverified and blocks like a rejection. Candidates (threshold crossed, matched, observed) enter the probability
    history whatever the checks say; only eligible rows move the cooldown. No positions are implied.
    """
    d = static_checks(d, policies).withColumn("candidate", (c("crossed") & F.coalesce("matched", F.lit(False)) & F.coalesce("observed", F.lit(False))).cast("int"))
    clean = F.lit(True)
    for n in CHECKS[:6]:
        clean = clean & F.coalesce(c(f"check_{n}").isin("passed", "disabled"), F.lit(False))
    d = d.withColumn("_clean", clean.cast("int"))
    walk = chained(d, _walk, [float("nan")], "q int, cool int, eligible int, before double", ["probability", "_q", "_cool", "candidate", "_clean"], size, keys=keys)
    name = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    walk = walk.select(*keys, "bar_idx", name[c("q")].alias("check_quantile"), name[c("cool")].alias("check_cooldown"), "eligible", F.when(~F.isnan("before"), c("before")).cast("long").alias("last_before"))
    d = d.join(walk, [*keys, "bar_idx"]).drop("_q", "_cool", "_clean")
    return d.withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(c(f"check_{n}").isin("rejected", "unverified"), F.concat(F.lit(f"{n}:"), c(f"check_{n}"))) for n in CHECKS])), ";"))

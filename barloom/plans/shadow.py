"""OP10: shadow policies over predictions, regimes, expected moves and selected setups."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import setups as su
from barloom.operators import shadow as sh
from barloom.plans.registry import QUERIES, query
from barloom.plans.setups import FIRED, setups_t
from barloom.plans.trade import predictions

SPREADS = (("asia", 40.0), ("london", 20.0), ("overlap", 10.0), ("new_york", 30.0))  # off hours have no known spread
POLICIES = (
    sh.Policy("m1", 0.3, ("stress",), ("off_hours",), ("range_low",), (("up_normal", "london"),), (("range_high", "stress"),), 2.0, 0.2, 5, SPREADS),
    sh.Policy("m2", 0.4, (), ("asia",), (), (("range_normal", "asia"),), (), 1.0, None, 3, SPREADS),
)
OUT = "model_id:s symbol:s bar_idx:l candidate:l eligible:l last_before:l reasons:s " + " ".join(f"check_{n}:s" for n in sh.CHECKS)


def _status(on, inputs, bad):
    return f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in inputs)} THEN 'unverified' WHEN coalesce({bad}, true) THEN 'rejected' ELSE 'passed' END" if on else "'disabled'"


def _in(x, values):
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def _checks(p):
    pair = lambda a, b, ps: "(" + " OR ".join(f"({a} = '{x}' AND {b} = '{y}')" for x, y in ps) + ")"
    spread = "CASE session_regime " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in p.spreads) + " END"
    return {"stress": _status(p.high_stress, ["stress_regime"], _in("stress_regime", p.high_stress)), "session": _status(p.sessions, ["session_regime"], _in("session_regime", p.sessions)), "composite": _status(p.composites, ["composite_regime"], _in("composite_regime", p.composites)),
            "composite_session": _status(p.composite_sessions, ["composite_regime", "session_regime"], pair("composite_regime", "session_regime", p.composite_sessions)),
            "composite_stress": _status(p.composite_stress, ["composite_regime", "stress_regime"], pair("composite_regime", "stress_regime", p.composite_stress)),
            "expected_move": _status(p.least_move_to_spread is not None, ["expected_move", f"({spread})"], f"expected_move < {p.least_move_to_spread} * ({spread})")}


_ROWS = " UNION ALL ".join(f"SELECT model_id, symbol, bar_idx, probability, probability >= {p.threshold} AND matched AS candidate, {p.least_quantile or 'NULL'}::DOUBLE AS q, {p.cooldown}::BIGINT AS cool, {', '.join(f'{x} AS check_{n}' for n, x in _checks(p).items())} FROM o WHERE model_id = '{p.model_id}'" for p in POLICIES)
_CLEAN = " AND ".join(f"check_{n} IN ('passed', 'disabled')" for n in sh.CHECKS[:6])
SQL = f"""WITH RECURSIVE f AS MATERIALIZED ({FIRED}), o AS (SELECT p.*, g.stress_regime, g.composite_regime, e.expected_move, s.symbol IS NOT NULL AS matched FROM pred p JOIN ({QUERIES['dt13_regimes'].sql}) g ON g.symbol = p.symbol AND g.bar_idx = p.bar_idx JOIN ({QUERIES['wn23_expected_move'].sql}) e ON e.symbol = p.symbol AND e.bar_idx = p.bar_idx
 LEFT JOIN (SELECT DISTINCT symbol, bar_idx FROM f WHERE lane = 'primary' AND side = 1) s ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx),
 c AS MATERIALIZED (SELECT *, ({_CLEAN}) AS clean, row_number() OVER (PARTITION BY model_id, symbol ORDER BY bar_idx) AS n FROM ({_ROWS})),
 z AS (SELECT model_id, symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last, CAST([] AS DOUBLE[]) AS seen, 0 AS a, 0 AS b, 0 AS eligible, CAST(NULL AS BIGINT) AS last_before FROM c WHERE n = 1
 UNION ALL SELECT model_id, symbol, n, CASE WHEN ok THEN bar_idx ELSE last END, CASE WHEN candidate THEN list_append(seen[-{sh.HISTORY - 1}:], probability) ELSE seen END, a, b, CASE WHEN ok THEN 1 ELSE 0 END, last FROM (
 SELECT *, candidate AND clean AND a IN (0, 2) AND b IN (0, 2) AS ok FROM (SELECT c.*, z.last, z.seen, CASE WHEN c.q IS NULL THEN 2 WHEN len(z.seen) > 0 AND c.probability <= list_aggregate(list_append(z.seen, c.probability), 'quantile_cont', 0.2) THEN 1 ELSE 0 END AS a,
 CASE WHEN c.cool IS NULL THEN 2 WHEN z.last IS NOT NULL AND c.bar_idx - z.last <= c.cool THEN 1 ELSE 0 END AS b FROM z JOIN c ON c.model_id = z.model_id AND c.symbol = z.symbol AND c.n = z.n + 1))),
 r AS (SELECT c.*, z.eligible, z.last_before, ['passed', 'rejected', 'disabled'][z.a + 1] AS check_quantile, ['passed', 'rejected', 'disabled'][z.b + 1] AS check_cooldown FROM z JOIN c ON c.model_id = z.model_id AND c.symbol = z.symbol AND c.n = z.n)
 SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN check_{n} IN ('rejected', 'unverified') THEN '{n}:' || check_{n} END" for n in sh.CHECKS)}], lambda x: x IS NOT NULL), ';') AS reasons FROM r"""


@query("outcome10_shadow_policy", OUT, SQL)
def _(m):
    regimes = QUERIES["dt13_regimes"].build(m).select("symbol", "bar_idx", "stress_regime", "composite_regime")
    move = QUERIES["wn23_expected_move"].build(m).select("symbol", "bar_idx", "expected_move")
    fired = su.admitted(setups_t(m)).filter("lane = 'primary' AND side = 1").select("symbol", "bar_idx").distinct().withColumn("matched", F.lit(True))
    d = predictions(m).join(regimes, ["symbol", "bar_idx"]).join(move, ["symbol", "bar_idx"]).join(fired, ["symbol", "bar_idx"], "left").withColumn("observed", F.lit(True))
    return sh.evaluate(d, POLICIES)

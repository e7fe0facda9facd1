"""AG28 event metrics and AG45, AG46, ML05: pruning and the whole preparation of one target."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators import features as ff
from barloom.operators import metrics as mt
from barloom.operators import prune as pn
from barloom.operators.blocks import blocked
from barloom.operators.prepare import embargoed_split, fill_statistics
from barloom.plans.registry import S, query, s_lead, shared
from barloom.plans.trade import predictions

# ---- AG28 ---------------------------------------------------------------------------------------------------------------------
CUTS = (0.5, 0.7, 0.9)
_K = "model_id, symbol, threshold"
EVENTS = f"""WITH RECURSIVE zn AS MATERIALIZED (SELECT model_id, symbol, row_number() OVER (PARTITION BY model_id, symbol ORDER BY min(bar_idx)) AS zone, min(bar_idx) AS z0, max(bar_idx) AS z1 FROM (
 SELECT *, bar_idx - row_number() OVER (PARTITION BY model_id, symbol ORDER BY bar_idx) AS g FROM pred WHERE target = 1) GROUP BY model_id, symbol, g),
 h AS MATERIALIZED (SELECT p.*, t.threshold, row_number() OVER (PARTITION BY model_id, symbol, t.threshold ORDER BY bar_idx) AS rn FROM pred p CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in CUTS)}) t(threshold) WHERE probability >= t.threshold),
 r AS (SELECT {_K}, rn, bar_idx, bar_idx AS last FROM h WHERE rn = 1 UNION ALL SELECT h.model_id, h.symbol, h.threshold, h.rn, h.bar_idx, CASE WHEN h.bar_idx - r.last > 3 THEN h.bar_idx ELSE r.last END FROM r JOIN h ON h.model_id = r.model_id AND h.symbol = r.symbol AND h.threshold = r.threshold AND h.rn = r.rn + 1),
 e AS MATERIALIZED (SELECT {_K}, bar_idx, row_number() OVER (PARTITION BY {_K} ORDER BY bar_idx) AS n FROM r WHERE last = bar_idx),
 g AS (SELECT {_K}, n, (SELECT list(zone) FROM zn z WHERE z.model_id = e.model_id AND z.symbol = e.symbol AND e.bar_idx BETWEEN z.z0 - 2 AND z.z1 + 2) AS fit FROM e),
 gm AS MATERIALIZED (SELECT * FROM g),
 w AS (SELECT {_K}, n, CASE WHEN fit IS NULL THEN CAST([] AS BIGINT[]) ELSE [list_min(fit)] END AS used, CASE WHEN fit IS NULL THEN 0 ELSE 1 END AS matched FROM gm WHERE n = 1 UNION ALL
 SELECT gm.model_id, gm.symbol, gm.threshold, gm.n, CASE WHEN len(list_filter(coalesce(gm.fit, []), lambda z: NOT list_contains(w.used, z))) > 0 THEN list_append(w.used[-20:], list_min(list_filter(gm.fit, lambda z: NOT list_contains(w.used, z)))) ELSE w.used END,
 CASE WHEN len(list_filter(coalesce(gm.fit, []), lambda z: NOT list_contains(w.used, z))) > 0 THEN 1 ELSE 0 END FROM w JOIN gm ON gm.model_id = w.model_id AND gm.symbol = w.symbol AND gm.threshold = w.threshold AND gm.n = w.n + 1)
 SELECT *, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS fbeta FROM (SELECT m.model_id, m.threshold, coalesce(events, 0) AS events, coalesce(zones, 0) AS zones, coalesce(matched, 0) AS matched,
 CASE WHEN events > 0 THEN matched * 1.0 / events ELSE 0 END AS precision, CASE WHEN zones > 0 THEN coalesce(matched, 0) * 1.0 / zones ELSE 0 END AS recall FROM (SELECT DISTINCT model_id, t.threshold FROM pred CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in CUTS)}) t(threshold)) m
 LEFT JOIN (SELECT model_id, threshold, count(*) AS events, sum(matched) AS matched FROM w GROUP BY 1, 2) a USING (model_id, threshold) LEFT JOIN (SELECT model_id, count(*) AS zones FROM zn GROUP BY 1) b USING (model_id))"""


@query("ag28_zone_event_metrics", "model_id:s threshold events:l zones:l matched:l precision recall fbeta", EVENTS)
def _(m):
    return mt.event_metrics(predictions(m), list(CUTS), 3, 2)


# ---- AG45, AG46, ML05 ---------------------------------------------------------------------------------------------------------
COLUMNS = ["open", "close", "close_again", "one", "tiny", "candle_range", "true_range", "atr_14", "atr_50", "rolling_vol_20", "rolling_vol_60", "volume", "body_share"]
EMBARGO, TOP = 24, 6
shared("prep0", f"""SELECT b.symbol, b.bar_idx, b.open, b.close, b.close AS close_again, 1.0 AS one, b.bar_idx % 2 * 1e-6 AS tiny, b.high - b.low AS candle_range, v.true_range, v.atr_14, v.atr_50, v.rolling_vol_20, v.rolling_vol_60, b.volume,
 CASE WHEN b.high > b.low THEN abs(b.close - b.open) / (b.high - b.low) END AS body_share, CASE WHEN {s_lead('b.close', 1, 'PARTITION BY b.symbol ORDER BY b.bar_idx')} > b.close THEN 1.0 ELSE 0.0 END AS label,
 CASE WHEN {s_lead('b.close', 1, 'PARTITION BY b.symbol ORDER BY b.bar_idx')} IS NOT NULL AND b.bar_idx >= 20 THEN 1 ELSE 0 END AS usable FROM bars b JOIN vol v USING (symbol, bar_idx)""")
shared("prep1", f"SELECT * EXCLUDE (bar_idx, usable), row_number() OVER ({S}) - 1 AS bar_idx FROM prep0 WHERE usable = 1")
shared("prep2", """SELECT *, CASE WHEN bar_idx < t1 THEN 'train' WHEN bar_idx < t2 AND bar_idx >= t1 - 1 + 24 THEN 'val' WHEN bar_idx >= t2 AND bar_idx >= t2 - 1 + 24 THEN 'test' END AS split FROM (
 SELECT *, floor(0.7::DOUBLE * count(*) OVER (PARTITION BY symbol)) AS t1, floor(0.85::DOUBLE * count(*) OVER (PARTITION BY symbol)) AS t2 FROM prep1)""")
_FILLED = [x for x in COLUMNS if x not in ("open", "close", "close_again", "one", "tiny", "candle_range", "true_range", "volume")]
shared("fills", "SELECT " + ", ".join(f"CASE WHEN abs(skewness({x})) > 1 THEN quantile_cont({x}, 0.5) ELSE avg({x}) END AS f_{x}" for x in _FILLED) + " FROM prep2 WHERE split = 'train'")
shared("prep3", "SELECT p.* REPLACE (" + ", ".join(f"coalesce(p.{x}, f_{x}) AS {x}" for x in _FILLED) + ") FROM prep2 p CROSS JOIN fills")
_CONST, _LEFT = ["one"], [x for x in COLUMNS if x not in ("one", "close_again", "tiny")]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_LEFT.index(a)} AS ia, {_LEFT.index(b)} AS ib, abs(corr({a}, {b})) AS r FROM prep3 WHERE split = 'train'" for i, a in enumerate(_LEFT) for b in _LEFT[i + 1:])
_ASSOC = " UNION ALL ".join(f"SELECT '{a}' AS n, abs(corr({a}, label)) AS s FROM prep3 WHERE split = 'train'" for a in _LEFT)
_MARK = " UNION ALL ".join(f"SELECT '{x}' AS n, {i} AS position, count(DISTINCT {x}) AS d, var_samp({x}) AS v, bool_and({x} = close) AS is_close FROM prep3 WHERE split = 'train'" for i, x in enumerate(COLUMNS))
shared("fate", f"""WITH RECURSIVE sc AS MATERIALIZED ({_ASSOC}), pr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(r, 9) DESC, ib, ia) AS k FROM ({_PAIRS}) WHERE r >= 0.98),
 st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(d VARCHAR, k VARCHAR)[]) AS gone UNION ALL SELECT pr.k, CASE WHEN list_contains(list_transform(st.gone, lambda g: g.d), pr.a) OR list_contains(list_transform(st.gone, lambda g: g.d), pr.b) THEN st.gone ELSE
 list_append(st.gone, CASE WHEN round(x.s, 12) > round(y.s, 12) THEN {{'d': pr.b, 'k': pr.a}} WHEN round(y.s, 12) > round(x.s, 12) THEN {{'d': pr.a, 'k': pr.b}} ELSE {{'d': greatest(pr.a, pr.b), 'k': least(pr.a, pr.b)}} END) END
 FROM st JOIN pr ON pr.k = st.k + 1 JOIN sc x ON x.n = pr.a JOIN sc y ON y.n = pr.b),
 dr AS (SELECT unnest(gone, recursive := true) FROM (SELECT gone FROM st ORDER BY k DESC LIMIT 1))
 SELECT m.n AS column_name, m.position, CASE WHEN m.d <= 1 THEN 'constant' WHEN is_close AND m.n <> 'close' THEN 'duplicate' WHEN NOT v > 1e-8 THEN 'low_variance' WHEN dr.d IS NOT NULL THEN 'collinear' ELSE 'kept' END AS reason,
 CASE WHEN m.d > 1 AND is_close AND m.n <> 'close' THEN 'close' ELSE dr.k END AS kept_column, sc.s AS association FROM ({_MARK}) m LEFT JOIN dr ON dr.d = m.n LEFT JOIN sc ON sc.n = m.n""")


def prepared_t(m):
    """Usable rows, renumbered, split with an embargo, filled by statistics of the training part."""
    def build():
        def make(d, w):
            nxt = w.lead("close")
            return d.withColumns({"close_again": c("close"), "one": F.lit(1.0), "tiny": c("bar_idx") % 2 * 1e-6, "body_share": F.when(c("high") > c("low"), F.abs(c("close") - c("open")) / (c("high") - c("low"))),
                                  "label": flag(nxt > c("close")).cast("double"), "usable": nxt.isNotNull() & (c("bar_idx") >= 20)})
        d = blocked(m.bars(), lambda d, w: make(ff.volatility(ff.price_action(d, w), w), w), before=61, after=1).filter("usable").select("symbol", (c("bar_idx") - 20).alias("bar_idx"), "label", *COLUMNS)
        d = m.stage("prepared_split", lambda: embargoed_split(d, EMBARGO))
        fills = {r.column_name: r.fill for r in fill_statistics(d.filter("split = 'train'"), _FILLED).collect()}  # one number a column
        return d.fillna(fills)
    return m.stage("prepared", build)


def fates(m):
    d = prepared_t(m).filter("split = 'train'")
    return pn.prune(d, COLUMNS, "label", ["symbol", "bar_idx"])


@query("ag46_greedy_pruning", "column_name:s position:l reason:s kept_column:s association", "SELECT * FROM fate")
def _(m):
    return fates(m)


@query("ag45_column_fingerprints", "column_name:s twin_of:s", f"""SELECT column_name, CASE WHEN reason = 'duplicate' THEN kept_column END AS twin_of FROM fate""")
def _(m):
    return fates(m).withColumn("twin_of", F.when(c("reason") == "duplicate", c("kept_column")))


@query("ml05_target_preparation", "symbol:s bar_idx:l split:s feature:s value", f"""SELECT u.symbol, u.bar_idx, u.split, u.feature, u.value FROM (UNPIVOT (SELECT symbol, bar_idx, split, {', '.join(_LEFT)} FROM prep3 WHERE split IS NOT NULL) ON {', '.join(_LEFT)} INTO NAME feature VALUE value) u
 JOIN (SELECT column_name FROM fate WHERE reason = 'kept' ORDER BY round(association, 9) DESC, column_name LIMIT {TOP}) k ON k.column_name = u.feature""")
def _(m):
    """The columns that stay, ranked by association with the label; the first ``TOP`` of them, in long form."""
    best = [r.column_name for r in fates(m).filter("reason = 'kept'").orderBy(F.desc(F.round("association", 9)), "column_name").limit(TOP).collect()]
    d = prepared_t(m).filter("split IS NOT NULL")
    return d.select("symbol", "bar_idx", "split", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("value")) for n in best])).alias("x")).select("symbol", "bar_idx", "split", "x.*")

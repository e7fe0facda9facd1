"""Eligibility, input contracts, causal checks, guards and table comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag


def finalised(bars: DataFrame, now: DataFrame, seconds: int, grace: int) -> DataFrame:
    """Bars whose interval ended ``grace`` seconds before ``now`` (a one-row frame); explicitly partial ones never qualify."""
    limit = now.select((F.floor((F.unix_timestamp("now") - grace - seconds) / seconds) * seconds).alias("_limit"))
    out = bars.join(F.broadcast(limit)).filter(F.unix_timestamp("ts") <= c("_limit")).drop("_limit")
    return out.filter(F.coalesce("is_complete", F.lit(True))) if "is_complete" in bars.columns else out


def eligibility(bars: DataFrame, seconds: int, is_open: Column, max_age: int = 90) -> DataFrame:
    """Ordered failed checks per observed bar and the kind of evaluation it allows."""
    delay = F.unix_timestamp("recorded_at") - F.unix_timestamp("ts") - seconds
    old = c("observation_kind").isin("backfill", "historical", "replay", "repair")
    live = F.regexp_replace(F.lower("feed_type"), "-", "_").isin("live", "real_time", "realtime")
    checks = [
        ("source_bar_off_grid", F.unix_timestamp("ts") % seconds != 0), ("bar_incomplete", ~c("is_complete")), ("bar_completion_unknown", c("is_complete").isNull()),
        ("bar_not_closed", delay < 0), ("bar_stale", delay > max_age), ("first_observation_unknown", c("first_observed_at").isNull()),
        ("observation_after_prediction", c("first_observed_at") > c("recorded_at")), ("feed_not_live", ~F.coalesce(live, F.lit(False))),
        ("backfilled_evaluation", old), ("observation_kind_unknown", ~old & (c("observation_kind") != "live")), ("source_bar_market_closed", ~is_open)]
    out = bars.withColumn("_why", F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks])))
    kind = (F.when(old, "backfilled").when((delay > max_age) & True, "delayed").when((~c("is_complete")) | (delay < 0), "provisional")
            .when(F.size("_why") == 0, "live").otherwise("diagnostic"))
    return out.withColumns({"eligible": flag(F.size("_why") == 0), "reasons": F.array_join("_why", ","), "evaluation_kind": kind}).drop("_why")


def latest(df: DataFrame, keys=("symbol",), idx: str = "bar_idx") -> DataFrame:
    """Last row per key as one struct aggregate (no window over a whole history)."""
    row = F.max_by(F.struct(*df.columns), idx).alias("_r")
    return df.groupBy(*[c(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(row).select("_r.*")


def input_contract(features: DataFrame, names: list[str], required: DataFrame) -> DataFrame:
    """Per model: are all required features of the latest row available? Features arrive wide and are compared in long form."""
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    have = latest(features.select("symbol", "bar_idx", *names)).selectExpr("symbol", f"stack({len(names)}, {pairs}) as (feature, value)")
    need = features.select("symbol").distinct().join(F.broadcast(required))
    state = need.join(have.withColumn("_has", F.lit(1)), ["symbol", "feature"], "left")
    why = F.when(c("_has").isNull(), "missing_producer").when(c("value").isNull() | F.isnan("value"), "missing_history_or_input")
    return (state.withColumn("why", why).groupBy("symbol", "model_id")
            .agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"), F.sum(flag(c("why").isNull())).alias("available"))
            .withColumn("status", F.when(c("reasons") == "", "passed").otherwise("diagnostic_only")))


def warmup_status(features: DataFrame, names: list[str], minimum: int) -> DataFrame:
    last = latest(features.select("symbol", "bar_idx", *names))
    valid = sum((flag(c(n).isNotNull()) for n in names), F.lit(0))
    n = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars_available"))
    out = n.join(last.select("symbol", valid.alias("valid_features")), "symbol")
    ready = c("bars_available") >= minimum
    return out.withColumns({"history_ready": flag(ready), "ready": flag(ready & (c("valid_features") == len(names)))})


def first_causal_error(signals: DataFrame, known: str, t: dict[str, str]) -> DataFrame:
    """First broken timestamp-order rule of a signal, null when all hold. ``t`` maps roles to columns."""
    r = {k: c(v) for k, v in t.items()}
    k = c(known)
    rules = [
        (r["anchor"] > k, "anchor_after_known_at"), (r["confirm"] < r["anchor"], "confirmation_before_anchor"),
        (F.greatest(*[r[x] for x in ("confirm", "feat", "pred", "calib", "policy")]) > k, "input_unavailable_at_decision"),
        (r["src"] > r["feat"], "feature_source_after_feature_availability"),
        (~((r["feat"] <= r["pred"]) & (r["pred"] <= r["calib"]) & (r["calib"] <= r["policy"])), "prediction_pipeline_out_of_order"),
        (r["regime"] > r["policy"], "regime_unavailable_to_policy")]
    return signals.withColumn("reason", F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def report_guard(rows: DataFrame, by: str, single: dict[str, str]) -> DataFrame:
    """How many kinds each report mixes; admissible only when every guarded column has one value."""
    out = rows.groupBy(by).agg(*[F.count_distinct(v).alias(k) for k, v in single.items()])
    ok = F.lit(True)
    for k in single:
        ok = ok & (c(k) == 1)
    return out.withColumn("admissible", flag(ok))


def merge_families(base: DataFrame, families: dict[str, DataFrame], keys=("symbol", "ts")) -> DataFrame:
    """One-to-one merge of family flags; a duplicated family key raises."""
    out = base
    for name, df in families.items():
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("flag").alias(f"{name}_flag"))
        one = one.withColumn(f"{name}_flag", F.when(c("_n") == 1, c(f"{name}_flag")).otherwise(F.raise_error(F.lit(f"duplicate {name} keys")).cast("int"))).drop("_n")
        out = out.join(one, list(keys), "left")
    return out.fillna(0, [f"{n}_flag" for n in families])


def tolerant_compare(left: DataFrame, right: DataFrame, keys: list[str], features: list[str], atol: float, rtol: float) -> DataFrame:
    """Long cell-by-cell comparison over a full outer join; null matches null."""
    l = left.select(*keys, *[c(f).alias(f"_l_{f}") for f in features], F.lit(1).alias("_lk"))
    r = right.select(*keys, *[c(f).alias(f"_r_{f}") for f in features], F.lit(1).alias("_rk"))
    cells = ", ".join(f"'{f}', cast(_l_{f} as double), cast(_r_{f} as double)" for f in features)
    long = l.join(r, keys, "full_outer").selectExpr(*keys, "_lk", "_rk", f"stack({len(features)}, {cells}) as (feature, a, b)")
    both = c("_lk").isNotNull() & c("_rk").isNotNull()
    ok = both & ((c("a").isNull() & c("b").isNull()) | F.coalesce(F.abs(c("a") - c("b")) <= atol + rtol * F.abs("b"), F.lit(False)))
    return long.withColumns({"match": ok, "diff": F.abs(c("a") - c("b"))})


def compare_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature").agg(
        F.sum(flag(c("a").isNotNull() & c("b").isNotNull())).alias("compared"), F.sum(flag(c("match"))).alias("matched"),
        F.sum(flag(c("_lk").isNotNull() & c("_rk").isNull())).alias("only_left"), F.sum(flag(c("_rk").isNotNull() & c("_lk").isNull())).alias("only_right"),
        F.max("diff").alias("max_abs_diff"))

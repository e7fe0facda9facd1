"""Dataset preparation: imputation, column checks, embargoed splits, sampling and the Spark ML models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import c, flag
from barloom.operators.quantiles import quantiles


def _long(row: DataFrame, names: list[str], stats: list[str]) -> DataFrame:
    parts = ", ".join(f"'{n}', " + ", ".join(f"{s}_{n}" for s in stats) for n in names)
    return row.selectExpr(f"stack({len(names)}, {parts}) as (column_name, {', '.join(stats)})")


def fill_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """Bias-corrected skewness and the fill it selects: median beyond 1, else the mean, 0 for an all-missing column."""
    aggs = []
    for n in names:
        k = F.count(n).cast("double")
        aggs += [(F.skewness(n) * F.sqrt(k * (k - 1)) / F.when(k > 2, k - 2)).alias(f"skewness_{n}"), F.avg(n).alias(f"mean_{n}")]
    medians = quantiles(df, [], {f"median_{n}": (c(n), 0.5) for n in names})  # one row
    out = _long(df.agg(*aggs).crossJoin(F.broadcast(medians)), names, ["skewness", "mean", "median"])
    return out.withColumn("fill", F.coalesce(F.when(F.abs("skewness") > 1, c("median")).otherwise(c("mean")), F.lit(0.0)))


def column_profile(df: DataFrame, names: list[str]) -> DataFrame:
    aggs = []
    for n in names:
        aggs += [F.count_distinct(n).alias(f"distinct_values_{n}"), F.var_samp(n).alias(f"variance_{n}")]
    return _long(df.agg(*aggs), names, ["distinct_values", "variance"]).withColumn("constant", flag(c("distinct_values") <= 1))


def embargoed_split(df: DataFrame, embargo: int, train: float = 0.7, val: float = 0.85, keys=("symbol",), idx: str = "bar_idx") -> DataFrame:
    """Chronological split; the next part starts only ``embargo`` positions after the previous one ended. Bounds are one row per key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = n.select(*keys, F.floor(train * c("_n")).alias("_t1"), F.floor(val * c("_n")).alias("_t2"))
    d = df.join(b, list(keys))
    ends = d.groupBy(*keys).agg(F.max(F.when(c(idx) < c("_t1"), c(idx))).alias("_g1"), F.max(F.when(c(idx) < c("_t2"), c(idx))).alias("_g2"))
    d = d.join(ends, list(keys))
    part = (F.when(c(idx) < c("_t1"), "train").when((c(idx) < c("_t2")) & (c(idx) >= c("_g1") + embargo), "val")
            .when((c(idx) >= c("_t2")) & (c(idx) >= c("_g2") + embargo), "test"))
    return d.withColumn("split", part).drop("_t1", "_t2", "_g1", "_g2")


def balanced_sample(df: DataFrame, keys: list[str], label: str, order: list[str], ratio: float) -> DataFrame:
    """All positives and the first ``ratio`` negatives per positive in hash order. Ranks come from salted parts plus offsets."""
    pos = df.groupBy(*keys).agg(F.sum(label).alias("_p"))
    d = df.withColumn("_s", F.floor(c(order[0]) / 64))
    w = Window.partitionBy(*keys, label, "_s").orderBy(*order)
    ranked = d.withColumn("_r", F.row_number().over(w))
    sizes = d.groupBy(*keys, label, "_s").agg(F.count(F.lit(1)).alias("_n"))
    back = Window.partitionBy(*keys, label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, label, "_s", F.coalesce(F.sum("_n").over(back), F.lit(0)).alias("_b"))
    out = ranked.join(base, [*keys, label, "_s"]).join(pos, keys)
    return out.filter((c(label) == 1) | (c("_b") + c("_r") <= ratio * c("_p"))).drop("_s", "_r", "_b", "_p")


def train_and_score(df: DataFrame, features: list[str], label: str, train: str, trees: int = 10) -> DataFrame:
    """Weighted gradient-boosted trees on the training rows, probabilities for all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    d = df.fillna(0.0, features)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=3, seed=7)]).fit(d.filter(train))
    return model.transform(d).withColumn("probability", vector_to_array("probability")[1])


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return row.selectExpr(f"stack({len(pairs)}, {cells}) as (left_col, right_col, corr)")


def mutual_information(df: DataFrame, bins: str, label: str, name: str) -> DataFrame:
    """Plug-in estimate over a contingency table; the table, not the rows, meets the windows."""
    t = df.groupBy(bins, label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    px = t.groupBy(bins).agg(F.sum("n").alias("nx"))
    py = t.groupBy(label).agg(F.sum("n").alias("ny"))
    tot = t.agg(F.sum("n").alias("t"))
    d = t.join(px, bins).join(py, label).join(F.broadcast(tot))
    return d.agg(F.sum(c("n") / c("t") * F.log(c("n") * c("t") / (c("nx") * c("ny")))).alias("mi")).withColumn("feature", F.lit(name))


def encode(df: DataFrame, column: str, fit, name: str) -> DataFrame:
    """Alphabetical codes fitted on the given rows; unseen values become -1. The code table holds one row per distinct value."""
    seen = df.filter(fit).select(column).distinct()
    codes = seen.agg(F.array_sort(F.collect_set(column)).alias("_v")).select(F.posexplode("_v").alias(name, column))
    return df.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def robust_scale(df: DataFrame, names: list[str], fit) -> DataFrame:
    """(x - median) / interquartile range, both from the fitting rows only."""
    stats = quantiles(df.filter(fit), [], {f"_q{k}_{n}": (c(n), p) for n in names for k, p in enumerate((0.25, 0.5, 0.75))})  # one row
    d = df.join(F.broadcast(stats))
    iqr = lambda n: c(f"_q2_{n}") - c(f"_q0_{n}")
    return d.withColumns({f"{n}_scaled": (c(n) - c(f"_q1_{n}")) / F.when(iqr(n) != 0, iqr(n)).otherwise(1.0) for n in names}).drop(*[f"_q{k}_{n}" for n in names for k in range(3)])


def walk_forward(df: DataFrame, first_share: float, purge: int, folds: int, idx: str = "bar_idx") -> DataFrame:
    """Expanding training span, purged gap, validation span; a row appears once per fold it takes part in.

    Validation starts after ``first_share`` of the table's length and its ``folds`` spans cover the rest, so every later row is validated once.
    """
    ends = df.agg(F.max(idx).alias("_n")).select((c("_n") + 1).alias("_n"))  # one row
    d = df.crossJoin(F.broadcast(ends)).withColumn("_first", F.floor(c("_n") * first_share))
    d = d.withColumn("_step", F.greatest(F.ceil((c("_n") - c("_first")) / folds), F.lit(1))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = c("_first") + c("_step") * c("fold")
    role = F.when(c(idx) < start - purge, "train").when((c(idx) >= start) & (c(idx) < start + c("_step")), "val")
    return d.withColumn("role", role).filter("role is not null").drop("_n", "_first", "_step")


def calibrate(scored: DataFrame, fit) -> DataFrame:
    """Platt scaling fitted on out-of-fold rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    d = VectorAssembler(inputCols=["probability"], outputCol="_x").transform(scored.withColumnRenamed("target", "label"))
    model = LogisticRegression(featuresCol="_x", labelCol="label", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(d.filter(fit))
    return model.transform(d).withColumn("calibrated", vector_to_array("_p")[1])

"""Block partitioning of long per-symbol histories.

A window over ``partitionBy(symbol)`` puts a whole history into one task. Everything here splits a history into blocks of bounded
size, replicates the few neighbouring rows a bounded frame needs (the halo), and computes inside ``(symbol, block)``. The result is
exact for bounded frames; open-ended prefixes go through :func:`carry_last` / :func:`running`, which combine one summary row per
block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.store import saved

BLOCK_ROWS = 4096
KEYS = ("symbol",)


def number_rows(df: DataFrame, order: str = "ts", span_seconds: int = 4096 * 3600, keys: Sequence[str] = KEYS, name: str = "bar_idx") -> DataFrame:
    """Zero-based position per key without a whole-history window: rank inside a time chunk plus the chunk's offset."""
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.floor(F.unix_timestamp(order) / span_seconds))
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    ranked = chunked.withColumn("_rank", F.row_number().over(inside))
    return (ranked.join(offsets, [*keys, "_chunk"])
            .withColumn(name, (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_chunk", "_rank", "_base"))


def positions(df: DataFrame, order: Sequence[Column], chunk: Column, keys: Sequence[str], name: str) -> DataFrame:
    """Zero-based position per key in any order: rank inside a chunk plus the rows of the chunks before it. ``chunk`` must not fall along ``order``."""
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    return ranked.join(offsets, [*keys, "_chunk"]).withColumn(name, (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_chunk", "_rank", "_base")


def spread(df: DataFrame, before: int, after: int = 0, size: int = BLOCK_ROWS, idx: str = "bar_idx") -> DataFrame:
    """Assign rows to index blocks and copy each into the blocks whose halo needs it (adds ``block`` and ``own``)."""
    i = F.col(idx)
    if before == 0 and after == 0:
        return df.withColumns({"block": F.floor(i / size), "own": F.lit(True)})
    low = F.greatest(F.floor((i - after) / size), F.lit(0))
    blocks = F.sequence(low, F.floor((i + before) / size))
    return df.select("*", F.explode(blocks).alias("block")).withColumn("own", F.floor(i / size) == F.col("block"))


class Frame:
    """Row frames and count-gated aggregates inside one ``(keys, block)`` partition; one sort serves them all."""

    def __init__(self, keys: Sequence[str] = ("symbol", "block"), order: str | Sequence = "bar_idx"):
        order = [order] if isinstance(order, (str, Column)) else list(order)
        self.spec: WindowSpec = Window.partitionBy(*keys).orderBy(*order)

    def rows(self, a: int, b: int) -> WindowSpec:
        return self.spec.rowsBetween(a, b)

    def lag(self, c, k: int = 1) -> Column:
        return F.lag(c, k).over(self.spec)

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(c, k).over(self.spec)

    def full(self, agg: Callable[[Column], Column], c, n: int, shift: int = 0) -> Column:
        """``agg`` over the n rows ending ``shift`` rows back, null unless all n values are present."""
        c = F.col(c) if isinstance(c, str) else c
        w = self.rows(-(n - 1) - shift, -shift)
        return F.when(F.count(c).over(w) == n, agg(c).over(w))

    def mean(self, c, n: int, shift: int = 0) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        w = self.rows(-(n - 1) - shift, -shift)
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(F.count(c).over(w) == n, F.when(lo == hi, lo).otherwise(F.avg(c).over(w)))

    def std(self, c, n: int, shift: int = 0) -> Column:
        """Sample deviation; a constant window is exactly 0."""
        c = F.col(c) if isinstance(c, str) else c
        w = self.rows(-(n - 1) - shift, -shift)
        return F.when(F.count(c).over(w) == n,
                      F.when(F.min(c).over(w) == F.max(c).over(w), F.lit(0.0)).otherwise(F.stddev_samp(c).over(w)))

    def max(self, c, n: int, shift: int = 0) -> Column:
        return self.full(F.max, c, n, shift)

    def min(self, c, n: int, shift: int = 0) -> Column:
        return self.full(F.min, c, n, shift)

    def sum(self, c, n: int, shift: int = 0) -> Column:
        return self.full(F.sum, c, n, shift)

    def last(self, c, a: int = Window.unboundedPreceding, b: int = 0) -> Column:
        return F.last(c, ignorenulls=True).over(self.rows(a, b))

    def since(self, flag: Column, idx: str = "bar_idx") -> Column:
        """Rows since the flag last held, null before the first time."""
        return F.col(idx) - self.last(F.when(flag, F.col(idx)))


def blocked(df: DataFrame, build: Callable[[DataFrame, Frame], DataFrame], before: int, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Run ``build(rows, frame)`` inside index blocks with the given halo and keep each block's own rows."""
    out = build(spread(df, before, after, size), Frame())
    return out.filter("own").drop("block", "own")


def _edges(df: DataFrame, values: dict[str, Column], keys: Sequence[str], order: str, size: int):
    rows = df.withColumn("_blk", F.floor(F.col(order) / size))
    summary = rows.groupBy(*keys, "_blk").agg(*[v.alias(k) for k, v in values.items()])
    return rows, summary


def carry_last(df: DataFrame, values: dict[str, Column], keys: Sequence[str] = KEYS, order: str = "bar_idx",
               size: int = BLOCK_ROWS, strict: bool = False) -> DataFrame:
    """Exact ``last(value, ignoreNulls)`` over the whole history up to the row (before it when ``strict``)."""
    names = list(values)
    rows = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    rows, summary = _edges(rows, {f"_e_{n}": F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))) for n in names},
                           keys, order, size)
    back = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_blk", *[F.last(f"_e_{n}", True).over(back).alias(f"_c_{n}") for n in names])
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    inner = rows.withColumns({f"_l_{n}": F.last(f"_v_{n}", True).over(w) for n in names})
    out = inner.join(carry, [*keys, "_blk"], "left")
    return (out.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in names})
            .drop("_blk", *[f"{p}{n}" for n in names for p in ("_v_", "_l_", "_c_")]))


def running(df: DataFrame, sums: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, keys: Sequence[str] = KEYS,
            order: str = "bar_idx", size: int = BLOCK_ROWS) -> DataFrame:
    """Exact running sums / maxima over the whole history by block prefix; null inputs count as 0 / are skipped."""
    sums, maxs = sums or {}, maxs or {}
    rows = df.withColumns({**{f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}, **{f"_v_{n}": c for n, c in maxs.items()}})
    rows, summary = _edges(rows, {**{f"_e_{n}": F.sum(f"_v_{n}") for n in sums}, **{f"_e_{n}": F.max(f"_v_{n}") for n in maxs}},
                           keys, order, size)
    back = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_blk", *[F.sum(f"_e_{n}").over(back).alias(f"_c_{n}") for n in sums],
                           *[F.max(f"_e_{n}").over(back).alias(f"_c_{n}") for n in maxs])
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({**{f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in sums}, **{f"_l_{n}": F.max(f"_v_{n}").over(w) for n in maxs}})
    out = inner.join(carry, [*keys, "_blk"], "left")
    out = out.withColumns({**{n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_l_{n}") for n in sums},
                           **{n: F.greatest(f"_c_{n}", f"_l_{n}") for n in maxs}})
    return out.drop("_blk", *[f"{p}{n}" for n in [*sums, *maxs] for p in ("_v_", "_l_", "_c_")])


def week_anchor(ts: Column, weeks: int = 1, zone: str = "America/New_York") -> Column:
    """Number of the ``weeks``-long block whose local Saturday 12:00 anchor is the latest at or before ``ts``."""
    local = F.from_utc_timestamp(ts, zone)
    day = F.date_sub(F.to_date(local - F.expr("INTERVAL 12 HOURS")), 0)
    saturday = F.date_sub(day, F.pmod(F.weekday(day) - 5, F.lit(7)))
    # 1970-01-03 was a Saturday
    return F.floor(F.datediff(saturday, F.lit("1970-01-03").cast("date")) / (7 * weeks)).cast("long")


def weekly_spread(df: DataFrame, warmup: int = 2000, weeks: int = 1, idx: str = "bar_idx", keys: Sequence[str] = KEYS) -> DataFrame:
    """Calendar blocks with a warm-up prefix: block b holds its own rows and the ``warmup`` rows before its first one.

    The block starts form a table of one row per symbol and block; it is matched to rows through index buckets, so a hot symbol
    never meets all of its blocks.
    """
    keys = list(keys)
    own = df.withColumn("block", week_anchor(F.col("ts"), weeks))
    starts = own.groupBy(*keys, "block").agg(F.min(idx).alias("_start"))
    width = max(warmup, 1)
    buckets = F.sequence(F.greatest(F.floor((F.col("_start") - warmup) / width), F.lit(0)), F.floor(F.col("_start") / width))
    need = starts.withColumn("_bucket", F.explode(buckets)).withColumnRenamed("block", "_need")
    halo = (own.drop("block").withColumn("_bucket", F.floor(F.col(idx) / width)).join(need, [*keys, "_bucket"])
            .filter((F.col(idx) < F.col("_start")) & (F.col(idx) >= F.col("_start") - warmup))
            .withColumnRenamed("_need", "block").drop("_bucket", "_start").withColumn("own", F.lit(False)))
    return own.withColumn("own", F.lit(True)).unionByName(halo)


def kernel(df: DataFrame, fn: Callable, out_schema: str, inputs: Sequence[str], warmup: int = 2000, weeks: int = 26,
           idx: str = "bar_idx", keys: Sequence[str] = KEYS) -> DataFrame:
    """Recursive per-bar state over calendar blocks: ``fn(pdf sorted by idx) -> dict of arrays``; own rows only.

    Each task sees one block plus its warm-up, never a whole history.
    """
    keys = list(keys)
    cols = list(dict.fromkeys([*keys, idx, *inputs]))
    names = [f.strip().split(" ")[0] for f in out_schema.split(",")]

    def run(pdf):
        pdf = pdf.sort_values(idx, kind="stable").reset_index(drop=True)
        res = fn(pdf)
        out = pdf[[*keys, idx]].copy()
        for n in names:
            out[n] = res[n]
        return out[pdf["own"].to_numpy(bool)]

    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{k} {kt[k]}" for k in keys], f"{idx} {kt[idx]}", out_schema])
    src = weekly_spread(df.select(*dict.fromkeys([*cols, "ts"])), warmup, weeks, idx, keys).select(*cols, "block", "own")
    return src.groupBy(*keys, "block").applyInPandas(run, schema)


def chained(df: DataFrame, fn: Callable, zero: Sequence[float], out_schema: str, inputs: Sequence[str], size: int = BLOCK_ROWS, idx: str = "bar_idx",
            keys: Sequence[str] = KEYS, then: Sequence[str] = ()) -> DataFrame:
    """State machine over the whole history, block by block: ``fn(pdf sorted by idx and then, state) -> (dict of arrays, state)``.

    Every block first runs from ``zero``; then those whose predecessor (the nearest earlier block with rows) left another state than they started
    from run again, until none is left. The result is that of one pass over the history, whatever the block size. States that settle inside a block
    need two or three rounds; a rule whose state never settles is better stated as a chain of successors (:func:`reached`).
    """
    keys = list(keys)
    cols = list(dict.fromkeys([*keys, idx, *then, *inputs]))
    names = [f.strip().split(" ")[0] for f in out_schema.split(",")]
    rows = saved(df.select(*cols).withColumn("_blk", F.floor(F.col(idx) / size).cast("long")), "chained")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "_blk"])

    def entered(pdf):
        pdf = pdf.sort_values([idx, *then], kind="stable").reset_index(drop=True)
        state = pdf["_state"].iloc[0]
        return pdf, list(zero if state is None else state)

    def leave(pdf):
        import pandas as pd
        pdf, state = entered(pdf)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in [*keys, "_blk"]}, "_state": [[float(x) for x in fn(pdf, state)[1]]]})

    def result(pdf):
        pdf, state = entered(pdf)
        res, out = fn(pdf, state)[0], pdf[[*keys, idx]].copy()
        for n in names:
            out[n] = res[n]
        return out

    blocks = rows.select(*keys, "_blk").distinct()
    blocks = saved(blocks.withColumn("_prev", F.lag("_blk").over(Window.partitionBy(*keys).orderBy("_blk"))), "blocks")  # one row a block
    given = lambda states: rows.join(states, [*keys, "_blk"]).groupBy(*keys, "_blk")
    out = f"{named}, _state array<double>"
    first = blocks.select(*keys, "_blk", F.lit(None).cast("array<double>").alias("_state"))
    left = saved(first.withColumnRenamed("_state", "_in").join(given(first).applyInPandas(leave, out), [*keys, "_blk"]), "states")
    while True:
        before = left.select(*keys, F.col("_blk").alias("_prev"), F.col("_state").alias("_new"))
        come = blocks.join(before, [*keys, "_prev"]).select(*keys, "_blk", "_new")
        changed = saved(left.join(come, [*keys, "_blk"]).filter(~F.col("_in").eqNullSafe(F.col("_new"))).select(*keys, "_blk", F.col("_new").alias("_state")), "changed")
        if changed.isEmpty():
            break
        redone = given(changed).applyInPandas(leave, out).withColumnRenamed("_state", "_out").join(changed.withColumnRenamed("_state", "_new"), [*keys, "_blk"])
        left = saved(left.join(redone, [*keys, "_blk"], "left").select(*keys, "_blk", F.coalesce("_new", "_in").alias("_in"), F.coalesce("_out", "_state").alias("_state")), "states")
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in [*keys, idx]], out_schema])
    return given(left.select(*keys, "_blk", F.col("_in").alias("_state"))).applyInPandas(result, schema)


def following(points: DataFrame, events: DataFrame, keys: Sequence[str], at: str, idx: str, out: str, span: int = BLOCK_ROWS) -> DataFrame:
    """``points`` with the first position ``idx`` of ``events`` after ``at`` (null: none follows). Both are whole positions; ``span`` of them make a block."""
    line = (points.withColumns({"_o": -(F.col(at) * 2 + 1), "_ev": F.lit(None).cast("long")})
            .unionByName(events.select(*keys, F.col(idx).cast("long").alias("_ev")).distinct().withColumn("_o", -(F.col("_ev") * 2)), allowMissingColumns=True))
    known = carry_last(line.filter(F.col("_o").isNotNull()), {out: F.col("_ev")}, keys, "_o", 2 * span).filter("_ev IS NULL").drop("_o", "_ev")
    return known.unionByName(points.filter(F.col(at).isNull()).withColumn(out, F.lit(None).cast("long")))


def reached(nodes: DataFrame, keys: Sequence[str] = KEYS, idx: str = "bar_idx", until: str = "until") -> DataFrame:
    """(keys, idx): the greedy chain that starts at each key's first node and goes on to the first node after ``until`` (null: it ends).

    ``nodes`` holds one row a position. Every node gets its successor once; then successors are doubled, so that the rounds grow with the logarithm
    of the chain, not with the number of blocks.
    """
    keys = list(keys)
    at = [*keys, idx]
    succ = following(nodes.select(*at, F.col(until).cast("long").alias("_u")), nodes, keys, "_u", idx, "_to").drop("_u")
    start = nodes.groupBy(*keys).agg(F.min(idx).alias(idx)).withColumn("_on", F.lit(True))
    hops = saved(succ.join(start, at, "left").withColumn("_on", F.coalesce("_on", F.lit(False))), "hops")
    while not hops.filter("_on AND _to IS NOT NULL").isEmpty():
        on = hops.filter("_on AND _to IS NOT NULL").select(*keys, F.col("_to").alias(idx)).distinct().withColumn("_hit", F.lit(True))
        far = hops.select(*keys, F.col(idx).alias("_to"), F.col("_to").alias("_far"))
        hops = saved(hops.join(far, [*keys, "_to"], "left").join(on, at, "left").select(*at, F.col("_far").alias("_to"), (F.col("_on") | F.coalesce("_hit", F.lit(False))).alias("_on")), "hops")
    return hops.filter("_on").select(*at)


def with_kernel(df: DataFrame, fn: Callable, out_schema: str, inputs: Sequence[str], **kw) -> DataFrame:
    """``df`` with the kernel's columns joined on."""
    keys = list(kw.get("keys", KEYS))
    return df.join(kernel(df, fn, out_schema, inputs, **kw), [*keys, kw.get("idx", "bar_idx")])

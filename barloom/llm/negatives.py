"""Hard negatives by windows of exact scores, over Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by the place of their vector on a Hilbert curve through the dimensions of largest variance, and cut into Parquet
rows of ``BLOCK`` vectors: neighbours on the curve share a block, so a block spans a small box. Each block keeps the least and largest value of every
dimension. Interval arithmetic on that zone map bounds what any of its vectors can score with an anchor, and only blocks whose bounds meet one of
the anchor's windows are read for it; zone maps are read without the vectors. Anchors are first run over the few blocks with the highest bounds, which
raises the lower ends of their windows to the k-th score found there, and then over every block that can still matter.

The same search finds the positives (same label, one window without an upper end) and the negatives (other labels, one window for each positive).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import parts_for, shelved
from barloom.llm.topk import EXACT, quantised, usable

BLOCK = 1024  #: vectors of a block
SORT_ROWS = 1 << 18  #: vectors sorted by one task
ASKERS = 256  #: anchors packed into one row
ZONES = 256  #: zone maps packed into one row
GROUP = 16  #: packs of anchors that meet a block in one task
CURVE_DIMS, CURVE_BITS = 8, 7  #: dimensions of the curve and bits of each
SEEDS = 4  #: blocks read to raise windows
LOW, HIGH = -(1 << 62), 1 << 62
KINDS = ("<i2", "<i4", "<i8")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of grid coordinates below 2**bits on the Hilbert curve; dimensions times bits stay below 64."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo rotations and reflections, level by level
        low = q - 1
        for d in range(dims):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):  # Gray code across dimensions
        x[d] ^= x[d - 1]
    turn, q = np.zeros(x.shape[1], dtype=np.int64), top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | (x[d] >> b) & 1
    return place


def narrow(m: np.ndarray) -> tuple[str, bytes]:
    """Kind and bytes of an integer array in the narrowest of ``KINDS``."""
    kind = next((t for t in KINDS if not m.size or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max)), "<i8")
    return kind, m.astype(kind).tobytes()


def wide(raw: bytes, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(-1, dims).astype(np.int64)


def exact(left: np.ndarray, right: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays as doubles if sums of ``times`` products stay whole numbers there, else as they are."""
    if float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, times) < EXACT / 2:
        return left.astype(float), right.astype(float)
    return left, right


def bounds(vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that any point of each box can have with each vector."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    v, z = exact(np.abs(vectors), np.concatenate([lo, hi]), 2 * vectors.shape[1])
    if v.dtype.kind == "f":
        up, down, lo, hi = up.astype(float), down.astype(float), lo.astype(float), hi.astype(float)
    return (up @ lo.T + down @ hi.T).astype(np.int64), (up @ hi.T + down @ lo.T).astype(np.int64)


def curve(vectors: DataFrame) -> tuple[int, list[int], list[float], list[float]]:
    """Number of dimensions, those of the curve, and the origin and cell width of each; one row a dimension comes to the driver."""
    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            flat = r.column(0)
            size = np.diff(flat.offsets.to_numpy())
            values, dim = flat.flatten().to_numpy(zero_copy_only=False).astype(float), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            n = np.bincount(dim)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(np.bincount(dim, values)), pa.array(np.bincount(dim, values * values))], names=["dim", "n", "s", "ss"])

    got = vectors.select("vec").mapInArrow(sums, "dim long, n long, s double, ss double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    spread = {r.dim: (max(0.0, r.ss / r.n - (r.s / r.n) ** 2) ** 0.5, r.s / r.n) for r in got}
    chosen = sorted(sorted(spread, key=lambda d: (-spread[d][0], d))[:CURVE_DIMS])
    return len(spread), chosen, [spread[d][1] - 2.5 * spread[d][0] for d in chosen], [max(5.0 * spread[d][0] / (1 << CURVE_BITS), 1e-9) for d in chosen]


def placed(vectors: DataFrame, dims: int, chosen: list[int], origin: list[float], cell: list[float]) -> DataFrame:
    """(id, label, vec, place): vectors padded with zeros, packed as longs, with their place on the curve."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            flat = r.column(2)
            size = np.diff(flat.offsets.to_numpy())
            m = np.zeros((len(r), dims), dtype="<i8")
            m[np.repeat(np.arange(len(r)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat.flatten().to_numpy(zero_copy_only=False)
            grid = np.clip((m[:, chosen] - np.array(origin)) / np.array(cell), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            place = hilbert(grid, CURVE_BITS) if chosen else np.zeros(len(r), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array([v.tobytes() for v in m], pa.binary()), pa.array(place)], names=["id", "label", "vec", "place"])

    return vectors.select("id", "label", "vec").mapInArrow(run, "id long, label long, vec binary, place long")


def cut_blocks(vectors: DataFrame, rows: int, dims: int) -> DataFrame:
    """(block, label, n, ids, kind, weights, zone_kind, zone): runs of ``BLOCK`` vectors of one label in the order of the curve, and their zone maps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def pack(some: pa.Table) -> pa.RecordBatch:
            nonlocal number
            m = np.frombuffer(b"".join(some.column("vec").to_pylist()), dtype="<i8").reshape(len(some), dims)
            kind, raw = narrow(m)
            zone_kind, zone = narrow(np.stack([m.min(axis=0), m.max(axis=0)]))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((number, pa.int64()), (some.column("label")[0].as_py(), pa.int64()), (len(some), pa.int64()), (some.column("id").to_numpy().astype("<i8").tobytes(), pa.binary()),
                                               (kind, pa.string()), (raw, pa.binary()), (zone_kind, pa.string()), (zone, pa.binary()))], names=["block", "label", "n", "ids", "kind", "weights", "zone_kind", "zone"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            label = held.column("label").to_numpy()
            edges = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(held)]
            done = 0
            for s, e in zip(edges[:-1], edges[1:]):
                for at in range(s, e, BLOCK):
                    if at + BLOCK <= e or e < len(held):
                        done = min(at + BLOCK, e)
                        yield pack(held.slice(at, done - at))
            held = held.slice(done).combine_chunks()
        if held is not None and len(held):
            yield pack(held)

    ordered = vectors.repartitionByRange(parts_for(rows, SORT_ROWS), "label", "place", "id").sortWithinPartitions("label", "place", "id")
    return ordered.mapInArrow(run, "block long, label long, n long, ids binary, kind string, weights binary, zone_kind string, zone binary")


def _choose(dims: int, same: bool, seeds: int):
    """For one pack of anchors and one of zone maps: the blocks to read and the anchors that need each; with ``seeds`` only its highest bounds."""
    def run(asks: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(zones):
            z = zones.iloc[0]
            box = wide(z.zone, z.zone_kind, 2 * dims)
            lo, hi, blocks, label = box[:, :dims], box[:, dims:], np.frombuffer(z.blocks, "<i8"), np.frombuffer(z.labels, "<i8")
            for a in asks.itertuples():
                who, mine = np.frombuffer(a.ids, "<i8"), np.frombuffer(a.labels, "<i8")
                win = np.frombuffer(a.windows, "<i8").reshape(len(who), -1, 2)
                least, most = bounds(wide(a.weights, a.kind, dims), lo, hi)
                fits = (mine[:, None] == label[None]) == same
                meets = np.zeros(fits.shape, dtype=bool)
                for w in range(win.shape[1]):
                    meets |= (most >= win[:, w, 0][:, None]) & (least <= win[:, w, 1][:, None])
                fits &= meets
                if seeds:
                    ranked = np.where(fits, most, LOW)
                    best = np.argsort(-ranked, axis=1, kind="stable")[:, :seeds]
                    for i, j in zip(*np.nonzero(np.take_along_axis(fits, best, axis=1))):
                        out.append((a.pack, int(blocks[best[i, j]]), int(i), int(most[i, best[i, j]])))
                else:
                    for j in np.flatnonzero(fits.any(axis=0)):
                        out.append((a.pack, int(blocks[j]), np.flatnonzero(fits[:, j]).astype("<i4").tobytes(), 0))
        return pd.DataFrame(out, columns=["pack", "block", "who", "bound"])

    return run


def _read(dims: int, same: bool, k: int):
    """Of one block, for each anchor that reads it and each window: the k best scores inside."""
    def run(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(block):
            b = block.iloc[0]
            ids, vectors = np.frombuffer(b.ids, "<i8"), wide(b.weights, b.kind, dims)
            for a in asks.itertuples():
                some = np.frombuffer(a.who, "<i4")
                who = np.frombuffer(a.ids, "<i8")[some]
                win = np.frombuffer(a.windows, "<i8").reshape(-1, a.n_windows, 2)[some]
                x, y = exact(wide(a.weights, a.kind, dims)[some], vectors, dims)
                score = (x @ y.T).astype(np.int64)
                for w in range(win.shape[1]):
                    inside = (score >= win[:, w, 0][:, None]) & (score <= win[:, w, 1][:, None]) & (who[:, None] != ids[None])
                    for i in np.flatnonzero(inside.any(axis=1)):
                        at = np.flatnonzero(inside[i])
                        best = at[np.lexsort((ids[at], -score[i, at]))[:k]]
                        out += [(int(who[i]), w, int(ids[j]), int(score[i, j])) for j in best]
        return pd.DataFrame(out, columns=["anchor", "win", "id", "score"])

    return run


def _pack_asks(dims: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("anchor")
        kind, raw = narrow(np.frombuffer(b"".join(pdf["vec"]), dtype="<i8").reshape(-1, dims))
        most = max(len(w) for w in pdf["windows"])
        win = np.tile(np.array([HIGH, LOW], dtype="<i8"), (len(pdf), most, 1))  # an empty window where an anchor has fewer
        for i, w in enumerate(pdf["windows"]):
            if len(w):
                win[i, :len(w)] = np.array([tuple(x) for x in w], dtype="<i8")
        return pd.DataFrame({"pack": [int(pdf["pack"].iloc[0])], "ids": [pdf["anchor"].to_numpy("<i8").tobytes()], "labels": [pdf["label"].to_numpy("<i8").tobytes()], "kind": [kind], "weights": [raw],
                             "windows": [win.tobytes()], "n_windows": [most]})

    return run


def search(asks: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """(anchor, win, rank, id, score): the k first rows of each window of each anchor, by score, then smaller id.

    ``asks``: anchor, label, place, vec, windows (array of [low, high], both ends inside); ``same``: whether rows of the anchor's own label or of
    others are searched. A row never meets an anchor of its id.
    """
    asks = shelved(asks, "asks")
    packs = parts_for(asks.count(), ASKERS)
    n_blocks = blocks.count()
    bundles = parts_for(n_blocks, ZONES)
    zones = blocks.select("block", "label", "zone_kind", "zone").withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)).cast("int"))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, raw = narrow(np.concatenate([wide(z, t, 2 * dims) for z, t in zip(pdf["zone"], pdf["zone_kind"])]))
        return pd.DataFrame({"bundle": [int(pdf["bundle"].iloc[0])], "blocks": [pdf["block"].to_numpy("<i8").tobytes()], "labels": [pdf["label"].to_numpy("<i8").tobytes()], "zone_kind": [kind], "zone": [raw]})

    zones = shelved(zones.groupBy("bundle").applyInPandas(bundle, "bundle int, blocks binary, labels binary, zone_kind string, zone binary"), "zones")
    of_pack = F.pmod(F.xxhash64("anchor"), F.lit(packs)).cast("int")
    fields = "pack int, ids binary, labels binary, kind string, weights binary, windows binary, n_windows int"

    def read(asks: DataFrame, seeds: int) -> DataFrame:
        packed = shelved(asks.withColumn("pack", of_pack).select("pack", "anchor", "label", "vec", "windows").groupBy("pack").applyInPandas(_pack_asks(dims), fields), "packs")
        left = packed.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
        right = zones.withColumnRenamed("bundle", "of").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        met = left.groupBy("pack", "bundle").cogroup(right.groupBy("to", "of"))
        if seeds:
            chosen = _choose(dims, same, seeds)
            near = met.applyInPandas(lambda a, z: chosen(a, z), "pack int, block long, who int, bound long")
            order = F.row_number().over(Window.partitionBy("pack", "who").orderBy(F.desc("bound"), "block"))
            near = near.withColumn("nth", order).filter(F.col("nth") <= seeds)
            wanted = near.groupBy("pack", "block").agg(F.sort_array(F.collect_list("who")).alias("some"))  # at most ASKERS numbers
            as_bytes = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, "<i4").tobytes()), "binary")
            wanted = wanted.select("pack", "block", as_bytes("some").alias("who"))
        else:
            chosen = _choose(dims, same, 0)
            wanted = met.applyInPandas(lambda a, z: chosen(a, z), "pack int, block long, who binary, bound long").select("pack", "block", "who")
        wanted = shelved(wanted.withColumn("crowd", (F.col("pack") / GROUP).cast("int")), "reads")
        tile = wanted.select(F.col("block").alias("at"), F.col("crowd").alias("by")).distinct()
        payload = blocks.select(F.col("block").alias("at"), "ids", "kind", "weights").join(tile, "at")
        found = _read(dims, same, k)
        tiles = wanted.join(packed.drop("labels"), "pack").groupBy("block", "crowd").cogroup(payload.groupBy("at", "by"))
        hits = tiles.applyInPandas(lambda a, b: found(a, b), "anchor long, win int, id long, score long")
        rank = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id"))
        return hits.withColumn("rank", rank).filter(F.col("rank") <= k)

    floor = read(asks, SEEDS).filter(F.col("rank") == k).select("anchor", "win", F.col("score").alias("floor"))
    floor = floor.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("win", "floor"))).alias("floors"))  # one entry a window
    raised = F.transform("windows", lambda w, i: F.array(F.greatest(w[0], F.coalesce(F.try_element_at(F.col("floors"), i), w[0])), w[1]))
    return read(asks.join(floor, "anchor", "left").withColumn("windows", raised).drop("floors"), 0)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of floor(256 * x). An anchor's positives are the ``positives`` first other rows of its label; for each, the
    ``negatives`` first rows of other labels whose score lies from ``low`` to ``high`` per cent of the positive's, both ends inside. First means a
    higher score, then a smaller id. Rows with a null key or label, a null vector or any null or non-finite component take no part. Vectors of
    different length are compared over their common components. An anchor skips every row that carries its id; repeated anchor ids ask once (the
    least label, then vector), repeated candidates all count. Other columns are not read. Empty tables give no rows.
    """
    src = vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).withColumn("__label", label.cast("long"))
    src = src.select(F.col(key).cast("long").alias("id"), F.col("__label").alias("label"), F.col(vec).alias("raw"), F.col("__anchor").alias("anchor"))
    src = src.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("raw"))).select("id", "label", quantised(F.col("raw")).alias("vec"), "anchor")
    rows = src.count()
    dims, *shape = curve(src)
    dims = max(1, dims)
    blocks = shelved(cut_blocks(placed(src, dims, *shape), rows, dims), "blocks")
    once = src.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    anchors = shelved(placed(once, dims, *shape).withColumnRenamed("id", "anchor"), "anchors")
    open_end = F.array(F.array(F.lit(LOW), F.lit(HIGH)))
    near = shelved(search(anchors.withColumn("windows", open_end), blocks, dims, True, positives), "positives")
    down = lambda c: F.expr(f"({c} - pmod({c}, 100)) div 100")  # noqa: E731 - whole hundredths, rounded down
    window = F.array(down(f"(score * {low} + 99)"), down(f"(score * {high})"))
    asked = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", window.alias("w")))), lambda e: e["w"]).alias("windows"))  # one a positive
    found = search(anchors.join(asked, "anchor"), blocks, dims, False, negatives)
    pairs = near.select("anchor", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    got = found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(pairs, ["anchor", "win"])
    return got.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""

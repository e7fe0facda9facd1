"""Exact top-k inner-product search by MaxScore over sharded postings.

A vector is a document, a component index a term, its integer weight the impact. In a shard every term has a least and a largest weight; for a
query this gives a base (the sum of least contributions) and for each term a bound on what it can add. Terms in ascending order of bound: the
longest prefix that cannot lift a document to the threshold is non-essential. Essential postings are traversed for all rows of the shard,
non-essential terms are probed in descending order of bound for the rows that can still compete. Shards without an essential term are
skipped. Each shard keeps k rows a query; shards are merged by score, then id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import parts_for, shelved

SHARD_ROWS = 4096  #: rows of a shard
BLOCK_ROWS = 256  #: queries packed into one row
GROUP_BLOCKS = 64  #: query blocks that meet a shard in one task
STEP = 512  #: rows traversed before the threshold is renewed
PROBE = 8  #: non-essential terms probed between two cuts
LOW = -(1 << 62)
EXACT = float(1 << 53)


def quantised(v: Column) -> Column:
    """floor(256 * x) of each component as long."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * 256.0))


def usable(v: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(vectors) -> np.ndarray:
    """Rows of possibly different lengths as one array; a missing component weighs nothing."""
    rows = [np.asarray(v, dtype=np.int64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard (or query block): ids and weights as bytes in the narrowest integer type, heaviest rows first."""
    m = _matrix(pdf["vec"])
    order = np.argsort(-(m.astype(float) ** 2).sum(axis=1), kind="stable")
    m = m[order]
    kind = next((t for t in ("<i2", "<i4") if not m.size or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max)), "<i8")
    ids = pdf["id"].to_numpy(dtype="<i8")[order]
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "ids": [ids.tobytes()], "kind": [kind], "dims": [m.shape[1]], "weights": [m.astype(kind).tobytes()]})


PACKED = "part int, ids binary, kind string, dims int, weights binary"


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype="<i8")
    return ids, np.frombuffer(row.weights, dtype=row.kind).reshape(len(ids), row.dims).astype(np.int64)


def search(ids: np.ndarray, w: np.ndarray, own: int, q: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of one shard that score ``least`` or more; equal scores by smaller id."""
    dims = w.shape[1]
    if dims < len(q):
        w = np.pad(w, ((0, 0), (0, len(q) - dims)))
    else:
        q = np.pad(q, (0, dims - len(q)))
    return _search(ids, w, w.min(axis=0), w.max(axis=0), own, q, k, least)


def _search(ids, w, lo, hi, own, q, k, least):
    a, b = q * lo, q * hi
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(high - low, kind="stable")
    reach = low.sum() + np.cumsum((high - low)[order])  # most that a prefix of terms can give, all others at their least
    rest = np.concatenate([[0], np.cumsum(high[order])])  # most that the first i terms give
    best: list[tuple[int, int]] = []  # (-score, id), sorted
    for at in range(0, len(ids), STEP):
        plain = int(np.searchsorted(reach, least, side="left"))  # terms that are not essential
        if plain == len(q):
            break
        rows = np.arange(at, min(at + STEP, len(ids)))
        rows = rows[ids[rows] != own]
        score = w[np.ix_(rows, order[plain:])] @ q[order[plain:]]
        while True:
            alive = score + rest[plain] >= least
            if not alive.all():
                rows, score = rows[alive], score[alive]
            if plain == 0 or not len(rows):
                break
            some = order[max(0, plain - PROBE):plain]
            score = score + w[np.ix_(rows, some)] @ q[some]
            plain = max(0, plain - PROBE)
        if len(rows):
            best = sorted(best + [*zip((-score).tolist(), ids[rows].tolist())])[:k]  # each row comes once: equal entries are repeated rows
            if len(best) == k:
                least = max(least, -best[-1][0])
    return [(-s, i) for s, i in best]


def _meet(k: int, only_threshold: bool):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            ids, w = _unpack(shard.iloc[0])
            for block in queries.itertuples():
                qids, qw = _unpack(block)
                wide = max(w.shape[1], qw.shape[1])
                ww, qq = np.pad(w, ((0, 0), (0, wide - w.shape[1]))), np.pad(qw, ((0, 0), (0, wide - qw.shape[1])))
                if np.abs(ww).max(initial=0) * float(np.abs(qq).max(initial=0)) * max(1, wide) < EXACT / 2:
                    ww, qq = ww.astype(float), qq.astype(float)  # products and sums stay whole numbers below 2**53
                lo, hi = ww.min(axis=0), ww.max(axis=0)
                floor = np.frombuffer(block.least, dtype="<i8")
                for own, q, least in zip(qids.tolist(), qq, floor.tolist()):
                    got = _search(ids, ww, lo, hi, own, q, k, least)
                    if only_threshold:
                        out.append((block.part, own, 0, int(got[-1][0]) if len(got) == k else LOW))
                    else:
                        out += [(block.part, own, i, int(s)) for s, i in got]
        return pd.DataFrame(out, columns=["part", "query_id", "vec_id", "score"])

    return run


FOUND = "part int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other rows, ties to the smaller id.

    Rows whose vector is null or holds a null or non-finite component, and rows with a null id, take no part. Vectors of different length are
    compared over their common components; an empty vector scores 0. A query skips every row that carries its id; repeated query ids ask
    once (the first vector in order of components), repeated candidates all count. Fewer than k candidates: all. Empty tables give no rows.
    """
    src = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("raw"), "__query")
    src = src.filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", quantised(F.col("raw")).alias("vec"), F.col("__query").alias("query"))
    rows, asked = src.agg(F.count("*"), F.count_if("query")).first()
    shards, blocks = parts_for(rows, SHARD_ROWS), parts_for(asked, BLOCK_ROWS)

    def packed(d: DataFrame, n: int) -> DataFrame:
        return d.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")).groupBy("part").applyInPandas(_pack, PACKED)

    index = shelved(packed(src.select("id", "vec"), shards), "shards")
    once = src.filter("query").groupBy("id").agg(F.min("vec").alias("vec"))
    asking = shelved(packed(once, blocks), "queries")
    none = F.udf(lambda ids: np.full(len(ids) // 8, LOW, dtype="<i8").tobytes(), "binary")
    # every block meets one shard first: the k-th score found there is a floor for its whole search
    seeds = asking.withColumn("least", none("ids")).withColumn("shard", F.pmod(F.col("part"), F.lit(shards)))
    floor = seeds.groupBy("shard").cogroup(index.groupBy("part")).applyInPandas(lambda q, s: _meet(k, True)(q, s), FOUND)
    floor = floor.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("floors"))  # at most BLOCK_ROWS a block

    def lined_up(ids, floors):
        return np.array([(floors or {}).get(i, LOW) for i in np.frombuffer(ids, dtype="<i8").tolist()], dtype="<i8").tobytes()

    ready = shelved(asking.join(floor, "part", "left").withColumn("least", F.udf(lined_up, "binary")("ids", "floors")).drop("floors"), "floors")
    groups = parts_for(blocks, GROUP_BLOCKS)
    left = ready.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("group", F.pmod(F.col("part"), F.lit(groups)))
    right = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnRenamed("part", "shard")
    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInPandas(lambda q, s: _meet(k, False)(q, s), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

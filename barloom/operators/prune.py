"""Column pruning for a training table: constants, duplicates, low variance and collinear columns, all pairs from one Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import c



def fingerprints(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> dict[str, tuple]:
    """(rows, distinct values up to sampling error, two independent 64-bit sums of hashes of key and value) of each column; one row for all of them.

    Columns with equal values at equal keys have equal fingerprints, wherever their rows lie; nulls count as values.
    """
    aggs = []
    for n in columns:
        aggs += [F.bit_xor(F.xxhash64(*key, c(n))).alias(f"x_{n}"), F.sum(F.xxhash64(F.lit(17), *key, c(n)).cast("decimal(38,0)")).alias(f"s_{n}"), F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"), F.count(n).alias(f"n_{n}"), F.var_samp(n).alias(f"v_{n}")]
    r = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    return {n: (r.rows, r[f"n_{n}"], r[f"lo_{n}"], r[f"hi_{n}"], r[f"x_{n}"], r[f"s_{n}"], r[f"v_{n}"]) for n in columns}


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Correlations of all pairs of columns without nulls, and the number of rows.

    Columns are centred by their means (one row), every task adds up its products, and tasks are summed by matrix row: what is shuffled is one matrix a
    task, what comes back one matrix.
    """
    names = list(columns)
    centre = np.array(df.agg(*[F.avg(n) for n in names]).first(), dtype=object)
    centre = np.array([0.0 if x is None else float(x) for x in centre])
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((k, k)), 0
        for b in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in b.columns]) - centre
            total += x.T @ x
            rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(k)), pa.array(list(total), pa.list_(pa.float64())), pa.array([rows] * k)], names=["i", "products", "n"])

    tasks = df.select(*[c(n).cast("double").alias(n) for n in names]).mapInArrow(run, "i long, products array<double>, n long")
    cells = tasks.select("i", "n", F.posexplode("products").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out, rows = np.zeros((k, k)), 0
    for r in cells.collect():  # columns squared
        out[r.i, r.j], rows = r.x, r.n
    size = np.sqrt(np.diag(out))
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.outer(size, size), rows


def greedy_drop(columns: Sequence[str], corr: np.ndarray, association: dict[str, float], threshold: float) -> list[tuple[str, str, float]]:
    """(dropped, kept, correlation): pairs at or above ``threshold`` from the closest on; the column of lower association goes, of equal ones the later name."""
    pairs = [(columns[i], columns[j], abs(float(corr[i, j]))) for j in range(len(columns)) for i in range(j) if abs(corr[i, j]) >= threshold]
    gone, out = set(), []
    for a, b, r in sorted(pairs, key=lambda p: -round(p[2], 9)):
        if a in gone or b in gone:
            continue
        sa, sb = round(association[a], 12), round(association[b], 12)
        drop, keep = (b, a) if sa > sb else (a, b) if sb > sa else (max(a, b), min(a, b))
        gone.add(drop)
        out.append((drop, keep, r))
    return out


def prune(df: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], threshold: float = 0.98, least_variance: float = 1e-8) -> DataFrame:
    """(column_name, position, reason, kept_column, association): what becomes of each column of a table without nulls in them.

    Reasons in this order: constant, duplicate (of an earlier column), low_variance, collinear, or kept. Only statistics of columns reach the driver.
    """
    marks, first, fate = fingerprints(df, columns, key), {}, {}
    for n in columns:
        rows, count, lo, hi, *_ = marks[n]
        same = marks[n][:6]
        if lo == hi or rows == 0:
            fate[n] = ("constant", None)
        elif same in first:
            fate[n] = ("duplicate", first[same])
        elif not (marks[n][6] or 0.0) > least_variance:
            fate[n] = ("low_variance", None)
        first.setdefault(same, n)
    left = [n for n in columns if n not in fate]
    corr, _ = gram(df, [*left, label])
    score = {n: 0.0 if not np.isfinite(corr[i, -1]) else abs(float(corr[i, -1])) for i, n in enumerate(left)}
    for drop, keep, _ in greedy_drop(left, np.nan_to_num(corr[:-1, :-1]), score, threshold):
        fate[drop] = ("collinear", keep)
    out = [(n, i, *fate.get(n, ("kept", None)), score.get(n)) for i, n in enumerate(columns)]
    return df.sparkSession.createDataFrame(out, "column_name string, position int, reason string, kept_column string, association double")

"""Quality scores from pairwise preferences (Bradley-Terry).

Labelled texts give preference pairs, one of label 1 before one of label 0. A linear utility of text features is learned by logistic loss on the
feature differences of the pairs. The threshold is the quantile of training utilities that leaves as large a share below as label 0 has; the
score is a logistic curve of the utility that passes ``CUT`` there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = 0.3  #: score at the threshold
SAMPLE = 5_000  #: labelled texts of each label used for fitting, at most
PAIRS = 40_000  #: preference pairs drawn from them
RIDGE = 1e-3
SIGNS = b"#$%&*|!.,<>{}=/@-:;_'\"()?[]+~^\\`"
N_FEATURES = 12 + len(SIGNS)


def features(text: str | None) -> list[float]:
    """Length, characters, words and repetition of a whole text; an empty text has zeros (and whole ratios of one)."""
    raw = (text or "").encode()
    n, words = max(1, len(raw)), raw.split()
    m, lines = max(1, len(words)), raw.split(b"\n")
    share = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / n
    some, distinct = share[share > 0], max(1, len(set(words)))
    out = [np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m, share[65:91].sum() ** 0.5, share[48:58].sum() ** 0.5, share[128:].sum() ** 0.5, share[10] ** 0.5,
           -float((some * np.log(some)).sum()), np.log(distinct) / np.log(m + 1), distinct / m, (sum(a == b for a, b in zip(words, words[1:])) / m) ** 0.5, len(set(lines)) / len(lines)]
    return [*map(float, out), *np.sqrt(share[list(SIGNS)]).tolist()]


@dataclass
class Model:
    """Scores rows of features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        u = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (u - self.cut) + np.log(CUT / (1 - CUT)), -50, 50)))


NONE = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, share_bad: float, seed: int = 7) -> Model:
    """``share_bad``: share of label 0 among all training labels. Without both labels nothing is learned and every text scores ``CUT``."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return NONE
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(25):  # Newton steps
        miss = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        w = w + np.linalg.solve((d * (miss * (1 - miss))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w)), d.T @ miss / PAIRS - RIDGE * w)
    u = z @ w
    weight = np.where(y == 1, (1 - share_bad) / len(good), share_bad / len(bad))  # of the sample, so that labels weigh as in all training rows
    order = np.argsort(u, kind="stable")
    below = np.cumsum(weight[order])
    i = min(int(np.searchsorted(below, share_bad, side="left")), len(u) - 2) if len(u) > 1 else 0
    cut = float((u[order[i]] + u[order[min(i + 1, len(u) - 1)]]) / 2)
    slope, base, v = 1.0, np.log(CUT / (1 - CUT)), u - cut
    for _ in range(50):  # logistic slope with the level at the cut held
        p = 1 / (1 + np.exp(-np.clip(slope * v + base, -50, 50)))
        grad, curve = (weight * (y - p) * v).sum() - 1e-4 * slope, (weight * p * (1 - p) * v * v).sum() + 1e-4
        slope = float(np.clip(slope + np.clip(grad / curve, -1, 1), 0.05, 50))
    return Model(mean, scale, w, cut, slope)


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 5, is 0; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that are not held out, at most ``sample`` of each label (by hash of the key); labels other than 0 and 1 are left out."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k")))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = src.join(F.broadcast(picked), "k").select("y", "text").mapInArrow(_with_features, "y int, x array<double>").collect()  # 2 * sample rows of N_FEATURES
    if not rows:
        return NONE
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows]), counts.get(0, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``out`` (replaced if there is one). A null text counts as empty; every row keeps its columns."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(model.scores(np.array([features(t) for t in some]).reshape(-1, N_FEATURES)), dtype=float)

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.col(text).cast("string")))

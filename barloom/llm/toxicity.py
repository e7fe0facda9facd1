"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features: whole words, and stems (their first ``STEM`` letters), that toxic labels favour. Grades: 0 for texts labelled clean; toxic ones get 1 to
``GRADES`` by the number of such words (quantiles among toxic training texts). One weight per feature is shared by all thresholds:
P(grade >= k) = logistic(w.x - t_k), t_1 < t_2 < ... The result is the expected grade, the sum of these probabilities, and a text is toxic where
P(grade >= 1) reaches one half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import shelved

GRADES = 3
SAMPLE = 4_000  #: labelled texts of each label used for fitting, at most
STEM = range(3, 9)  #: letters of a stem
LEAST_TEXTS = 3  #: toxic training texts that hold a kept feature, at least, however many there are: kinds of toxicity may be rare
LEAST_ODDS = 30.0  #: times as common in toxic training texts as in clean ones, at least
WORD = re.compile(r"[^\W\d_]+")
RIDGE, ROUNDS = 0.1, 400  #: the ridge is a share of the weight of the texts that hold a feature
MOST_CACHED = 300_000  #: words without features that a worker remembers; the cache only spares work


def features(word: str) -> list[str]:
    """The word itself (marked by a full stop) and its stems."""
    return [word + ".", *(word[:k] for k in STEM if k <= len(word))]


@dataclass
class Model:
    """Weights of features and ordered thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    plain: set[str] = field(default_factory=set)

    def found(self, text: str | None) -> Counter:
        """How often each feature occurs in a text; letters in any case."""
        out = Counter()
        if not text or not self.words:
            return out
        words = WORD.findall(text.lower())
        for w in set(words).difference(self.plain):
            hits = [self.words[f] for f in features(w) if f in self.words]
            if hits:
                n = words.count(w)
                for i in hits:
                    out[i] += n
            else:
                self.plain.add(w)
        if len(self.plain) > MOST_CACHED:
            self.plain.clear()
        return out

    def chances(self, texts) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each text."""
        z = np.array([sum(self.weights[i] * (1 + np.log(n)) for i, n in self.found(t).items()) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -50, 50)))


def no_model() -> Model:
    return Model({}, np.zeros(0), np.full(GRADES, 50.0))


def kept(bad: dict[str, int], fine: dict[str, int], n_bad: int, n_fine: int) -> list[str]:
    """Features far commoner in toxic texts, strongest first; of a word and its stems, only the strongest stays."""
    odds = {f: ((n + 0.5) / (n_bad + 1)) / ((fine.get(f, 0) + 0.5) / (n_fine + 1)) for f, n in bad.items()}
    out: list[str] = []
    chosen, begun = set(), set()  # features kept, and all that they begin with
    for f in sorted((f for f in odds if odds[f] >= LEAST_ODDS), key=lambda f: (-np.log(odds[f]) * bad[f] ** 0.5, not f.endswith("."), f)):
        heads = {f[:k] for k in range(1, len(f) + 1)}
        if f not in begun and not heads & chosen:
            out.append(f)
            chosen.add(f)
            begun |= heads
    return out


def fit(names: list[str], found: list[Counter], toxic: np.ndarray) -> Model:
    """``found``: counts of features by index of each text. Without both labels nothing is learned and no text is toxic."""
    bad, fine = int(toxic.sum()), int((1 - toxic).sum())
    if not bad or not fine or not names:
        return no_model()
    row = np.array([i for i, c in enumerate(found) for _ in c], dtype=np.int64)
    col = np.array([k for c in found for k in c], dtype=np.int64)
    n = np.array([n for c in found for n in c.values()], dtype=float)
    val = 1 + np.log(n) if len(n) else n
    total = np.bincount(row, weights=val, minlength=len(found))
    edges = np.quantile(total[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + np.searchsorted(edges, total, side="right"), 0)
    weight = np.where(toxic == 1, 0.5 / bad, 0.5 / fine)
    ridge = RIDGE * np.bincount(col, weights=weight[row], minlength=len(names))  # a rare feature is not shrunk more than a common one
    w, first, gaps = np.zeros(len(names)), 1.0, np.zeros(GRADES - 1)  # thresholds: first, first + exp(gaps) summed up
    state = [np.zeros_like(w), 0.0, np.zeros_like(gaps)], [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    for step in range(1, ROUNDS + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, weights=val * w[col], minlength=len(found))
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - np.concatenate([[-60.0], t, [60.0]]), -60, 60)))  # P(grade >= 0 .. GRADES + 1)
        hit = np.arange(len(found)), grade
        here, above = up[hit], up[hit[0], grade + 1]
        p = np.maximum(here - above, 1e-12)
        dz = weight * (here * (1 - here) - above * (1 - above)) / p  # of the log likelihood by z
        dt = np.zeros(GRADES + 2)
        np.add.at(dt, grade, -weight * here * (1 - here) / p)
        np.add.at(dt, grade + 1, weight * above * (1 - above) / p)
        dt = dt[1:-1]
        grads = [np.bincount(col, weights=val * dz[row], minlength=len(names)) - ridge * w, dt.sum(), np.array([dt[k + 1:].sum() for k in range(GRADES - 1)]) * np.exp(gaps)]
        moved = []
        for i, (x, g) in enumerate(zip((w, first, gaps), grads)):  # Adam
            state[0][i] = 0.9 * state[0][i] + 0.1 * g
            state[1][i] = 0.99 * state[1][i] + 0.01 * g * g
            moved.append(x + 0.05 * (state[0][i] / (1 - 0.9 ** step)) / (np.sqrt(state[1][i] / (1 - 0.99 ** step)) + 1e-9))
        w, first, gaps = moved
    return Model({f: i for i, f in enumerate(names)}, w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, number of texts) within a partition."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["f", "n"])
        seen.clear()
        return b

    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                seen.update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
            if len(seen) > MOST_CACHED:
                yield out()
    yield out()


def _sparse(names: list[str]):
    """Label and counts of features of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), np.zeros(GRADES))
        for b in batches:
            got = [m.found(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[*c.keys()] for c in got], pa.list_(pa.int32())), pa.array([[*c.values()] for c in got], pa.list_(pa.int32()))], names=["y", "f", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts of each label (by hash of the key); labels other than 0 and 1 and null keys are left out."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = shelved(src.join(F.broadcast(picked), "k").select("y", "text"), "labelled")  # 2 * sample texts
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(totals) < 2:
        return no_model()

    def often(y: int, n: str) -> DataFrame:
        return rows.filter(F.col("y") == y).select("text").mapInArrow(_frequencies, "f string, n long").groupBy("f").agg(F.sum("n").alias(n))

    both = often(1, "bad").filter(F.col("bad") >= LEAST_TEXTS).join(often(0, "fine"), "f", "left").na.fill(0, ["fine"])
    odds = ((F.col("bad") + 0.5) / (totals[1] + 1)) / ((F.col("fine") + 0.5) / (totals[0] + 1))
    likely = both.filter(odds >= LEAST_ODDS / 2).collect()  # of the sample's words, so bounded like it; kept() decides
    names = kept({r.f: r.bad for r in likely}, {r.f: r.fine for r in likely}, totals[1], totals[0])
    got = rows.mapInArrow(_sparse(names), "y int, f array<int>, n array<int>").collect()  # a few numbers a text
    return fit(names, [Counter(dict(zip(r.f, r.n))) for r in got], np.array([r.y for r in got], dtype=np.int64))


def grade(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out`` (severity, p_toxic, grade, toxic); an existing column of that name is replaced.

    Severity is the expected grade, 0 to ``GRADES``; ``grade`` is the number of thresholds passed with one half or more. A null or empty text holds
    no word. Every row keeps its other columns.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = model.chances(list(texts))
            yield pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0], "grade": (p >= 0.5).sum(axis=1).astype("int32"), "toxic": p[:, 0] >= 0.5})

    return docs.withColumn(out, F.pandas_udf(run, "severity double, p_toxic double, grade int, toxic boolean")(F.col(text).cast("string")))

"""Large groups of near copies whose members straddle the threshold, and colliding identities."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import neardup


def straddling(n, seed=11):
    """Texts that each replace some words of a common one, so that pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w, at = list(base), rng.randrange(60)
        for j in range(rng.choice([1, 3, 5, 7])):
            w[(at + j) % 60] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


def plain_components(rows):
    shingles = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    number = {s: i for i, s in enumerate(sorted(set().union(*shingles)))}
    has = np.zeros((len(rows), len(number)), dtype=np.float32)
    for i, s in enumerate(shingles):
        has[i, [number[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    near = 100 * both >= 75 * (size[:, None] + size[None] - both)
    label = np.arange(len(rows))
    while True:
        least = np.where(near, label[None], len(rows)).min(axis=1)
        if (least == label).all():
            return label, int(near.sum() - len(rows)) // 2
        label = least


def test_large_straddling_group_links_stay_below_members(spark, monkeypatch):
    rows = straddling(3000)
    label, pairs = plain_components(rows)
    assert pairs > 20 * len(rows)  # a quadratic result would be far above the members
    found, real = [], neardup.components

    def counted(edges):
        found.append(edges.count())
        return real(edges)

    monkeypatch.setattr(neardup, "components", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    want = {i: int(c) for i, c in enumerate(label)}
    assert len(set(want.values())) > 1
    assert got == want
    assert sum(found) < 3 * len(rows)


def test_linked_emits_joining_links_only():
    rows = straddling(400)
    sets = [neardup.shingle_set(t, 5) for _, t in rows]
    sig = [r.tobytes() for r in neardup.signatures(sets)]
    out = []
    pa = neardup.pa
    for nth in range(neardup.CHUNKS * neardup.CHUNK):
        b = pa.RecordBatch.from_pydict({"block": [nth] * 400, "id": list(range(400)), "comp": list(range(400)), "side": pa.array([1] * 400, pa.int32()),
                                        "inner": [True] * 400, "nth": pa.array([nth] * 400, pa.int16()), "sig": pa.array(sig, pa.binary()), "text": [t for _, t in rows]})
        out += [x for r in neardup._linked(iter([b])) for x in zip(*(c.to_pylist() for c in r.columns))]
        assert len(out) <= 399 * (nth + 1)
    forest = neardup.Forest()
    for a, b in out:
        forest.join(a, b)
    label, _ = plain_components(rows)
    assert [forest.root(i) for i in range(400)] == label.tolist()


def test_rows_of_one_identity_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "row_id", lambda key="doc_id", text="text": F.when(F.col(key).isNotNull(), F.col(key).cast("long") % 3))
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(40))) for i in range(30)]
    rows += [(30, rows[4][1]), (31, rows[9][1])]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: {30: 4, 31: 9}.get(i, i) for i in range(32)}

"""Texts that no link and no passage concerns are not moved, however large the other side of their join is."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import common
from tests.llm.test_operators import plain_kept, prose

COLS = "doc_id long, text string, lang string, n_chars long"


@pytest.fixture
def shuffled(spark):
    """Sessions of the tests here join by shuffles, as large tables do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_moved(df, column="text"):
    """Rows with ``column`` that the shuffles of a plan that has run wrote."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(p.plan())
        else:
            if kind == "ShuffleExchangeExec" and f"{column}#" in p.output().mkString(","):
                total += p.metrics().apply("shuffleRecordsWritten").value()
            left += [p.children().apply(i) for i in range(p.children().size())]
    return total


def corpus(copies):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60, 9000), "en", i) for i in range(500)]
    return rows, [(1000 + i, rows[i][1] + f" end{i}", "en", i) for i in range(copies)]


def test_near_duplicates_move_few_texts(shuffled):
    rows, copies = corpus(12)
    again = [(7, rows[7][1], "de", 7), (2000, "some words here", "fr", 5), (2000, "some words here", "fr", 4), (None, "null key", "en", 1), (None, rows[3][1], "en", 2), (3000, None, "en", 0)]
    out = corpus_pipeline.one_of_each(shuffled, shuffled.createDataFrame(rows + copies + again, COLS), "")
    got = sorted(map(tuple, out.collect()), key=str)
    want = [r for r in rows if r[0] != 7] + [(7, rows[7][1], "de", 7), (2000, "some words here", "fr", 4), *again[3:]]
    assert got == sorted(want, key=str)
    assert rows_moved(out) < 200  # all of them before


def test_repeated_passages_move_few_texts(shuffled):
    rows, _ = corpus(0)
    passage = prose(random.Random(9), 50, 9000)
    rows = [(i, f"{t} {passage}" if i % 50 == 0 else t, *more) for i, t, *more in rows] + [(None, "short", "en", 1), (3000, None, "en", 0), (rows[5][0], rows[5][1], "de", 9)]
    out = corpus_pipeline.without_repeats(shuffled, shuffled.createDataFrame(rows, COLS), "")
    got = sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=str)
    kept = {k: t for k, t, *_ in plain_kept([(k, r[1]) for k, r in enumerate(rows)])}
    want = sorted(((r[0], kept[k], r[2]) for k, r in enumerate(rows)), key=str)
    assert got == want
    assert rows_moved(out) < 100  # all of them before


@pytest.mark.parametrize("most", [64, 1 << 24])
def test_parted_keeps_every_row_once(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAP", most)
    rows = spark.range(5000).withColumn("key", F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id"))))
    for ids in (rows.filter("id % 10 = 1").select("key"), rows.select("key").limit(0)):
        asked, others = common.parted(rows, ids, "key")
        assert asked.columns == others.columns == rows.columns
        assert sorted(r.id for r in asked.unionByName(others).collect()) == list(range(5000))
        assert others.join(ids, "key", "left_semi").isEmpty()

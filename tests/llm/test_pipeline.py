"""Queries of the llm subpackage against their SQL twins, and the pipeline against its stages in plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

import check_oracle
import corpus_pipeline
from barloom.llm import quality, queries, toxicity
from tests.llm.test_operators import plain_components, plain_kept

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    note, _, ok = check_oracle.compare(spark, con, name, queries.QUERIES[name], queries.SQL.get(name), ROOT)
    assert ok, note


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, ROOT).cache()
        rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
        if name in ("toxicity", "quality", "near_duplicates"):
            assert after.columns == docs.columns and after.join(before, "doc_id", "left_anti").isEmpty()
        if name == "near_duplicates":
            kept = {c[0] for c in plain_components(rows(before)) if c[3]}
            assert {i for i, _ in rows(after)} == kept
        if name == "repeated_passages":
            assert after.columns == docs.columns
            assert sorted(rows(after), key=str) == sorted(((k[0], k[1]) for k in plain_kept(rows(before))), key=str)
            assert after.filter(F.char_length("text") != F.col("n_chars")).isEmpty()
        if name == "packing":
            ids = {r.doc_id for r in after.collect()}
            assert ids == {i for i, _ in rows(before)}
        before = after


def test_classifiers_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = quality.held_out(F.col("doc_id"))
    known = docs.join(labels.filter(held), "doc_id")
    good = quality.score(known, quality.train(docs, labels))
    assert good.agg(F.avg(((F.col("score") >= quality.CUT) == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.98
    seen = toxicity.grade(known, toxicity.train(docs, labels.filter(~held))).select((F.col("toxicity.toxic").cast("int")).alias("said"), "toxic")
    right = {(r.toxic, r.said): r["count"] for r in seen.groupBy("toxic", "said").count().collect()}
    assert right[1, 1] / (right[1, 1] + right.get((1, 0), 0)) > 0.85
    assert right[0, 0] / (right[0, 0] + right.get((0, 1), 0)) > 0.97


def test_toxic_recall_of_each_language(spark):
    root, hits = "/root/testdata/sf0.1", {}
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    for k in range(4):
        held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k
        seen = toxicity.grade(docs.join(labels.filter(held), "doc_id"), toxicity.train(docs, labels.filter(~held)))
        for r in seen.groupBy("lang", "toxic", F.col("toxicity.toxic").alias("said")).count().collect():
            hits[r.lang, r.toxic, r.said] = hits.get((r.lang, r.toxic, r.said), 0) + r["count"]
    for lang in {x[0] for x in hits}:
        found, missed, wrong, clean = (hits.get((lang, y, said), 0) for y, said in ((1, True), (1, False), (0, True), (0, False)))
        assert found / (found + missed) > 0.6, lang
        assert wrong / (wrong + clean) < 0.02, lang


def test_pipeline_over_odd_rows(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (10 ** 9, "", "en", None, 0), (10 ** 9, "", "en", None, 0), (10 ** 9 + 1, None, None, "s", None)], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        d = rows.withColumn("key", F.lit("k")).withColumn("kept", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, ROOT)
            d.count()

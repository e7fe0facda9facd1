"""Cleaning of a document table in stages; each reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import neardup, packing, quality, substring, toxicity
from barloom.llm.common import parted, shelved, table
from barloom.store import checkpoint_root


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a toxic grade is below one half, in the model fitted to their labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model, out="__toxicity").filter(~F.col("__toxicity.toxic")).drop("__toxicity")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="__score").filter(F.col("__score") >= quality.CUT).drop("__score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least key, then least row identity, of each group of near duplicates. Rows with equal key and text count as one row,
    of which that with the least other columns stays; rows that repeat a key only are compared like any others."""
    rows = neardup.row_groups(docs).filter("id IS NOT NULL")
    least = rows.groupBy("group").agg(F.min(F.struct("doc", "id")).alias("stays"))
    who = [F.col("row").alias("__row"), F.col("check").alias("__check")]
    gone = rows.join(least, "group").filter("id <> stays.id").select(*who, F.lit(False).alias("__stays"))
    repeats = rows.groupBy(*who).count().filter("count > 1").select("__row", "__check", F.lit(True).alias("__stays"))
    fates = shelved(gone.unionByName(repeats).groupBy("__row", "__check").agg(F.min("__stays").alias("__stays")), "fates")
    names = docs.columns
    known = docs.withColumn("__row", neardup.row_id()).withColumn("__check", neardup.row_check())
    asked, others = parted(known, fates, "__row")  # others stay where they are; Spark would push a left_anti join below this
    left = asked.join(fates, ["__row", "__check"], "left")
    single = left.filter("__stays IS NULL").select(*names).unionByName(others.select(*names))
    if fates.filter("__stays").isEmpty():
        return single
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    several = left.filter("__stays").groupBy("__row", "__check").agg(F.min_by(whole, F.to_json(whole)).alias("__least"))
    return single.unionByName(several.select(*(F.col(f"__least.`{c}`") for c in names)))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages removed; words that stay are joined by one space and n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    safe = tuple(f"__carried{i}" for i in range(len(others)))  # their own names may be those of result columns
    got = substring.remove_repeats(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in zip(others, safe))), carry=safe)
    got = got.select("doc_id", F.col("kept").alias("text"), F.char_length("kept").cast("long").alias("n_chars"), *(F.col(n).alias(c) for c, n in zip(others, safe)))
    return got.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return packing.pack(docs, packing.words_and_end())


STAGES = [("toxicity", without_toxic), ("quality", good_quality), ("near_duplicates", one_of_each), ("repeated_passages", without_repeats), ("packing", packed)]
ORACLE_SQL = None  # trained stages have no SQL form; tests/llm compares them with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark).rstrip('/')}/barloom-llm/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

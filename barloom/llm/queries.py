"""One query per operator over its whole table, and its SQL twin where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import align, bpe, neardup, negatives, packing, quality, rules, substring, topk, toxicity, urls, warc, winnow
from barloom.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
SIDES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_top_k(spark: SparkSession, root: str) -> DataFrame:
    return topk.top_k(table(spark, root, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), packing.words_and_end())


def op3_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    got = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, root, "labels")))
    return got.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


def op4_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, root, "documents"))


def op5_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return winnow.compared(table(spark, root, "documents"))


def op6_warc(spark: SparkSession, root: str) -> DataFrame:
    got = warc.read(warc.write(table(spark, root, "pages")))
    return got.select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def op7_repeated_passages(spark: SparkSession, root: str) -> DataFrame:
    got = substring.remove_repeats(table(spark, root, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(table(spark, root, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    got = toxicity.grade(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, root, "labels")))
    return got.select("doc_id", "toxicity.severity", "toxicity.p_toxic", "toxicity.grade", F.col("toxicity.toxic").cast("int").alias("toxic"))


def op10_bpe(spark: SparkSession, root: str) -> DataFrame:
    raw = bpe.rank_file(public_tokenizers.path(RANKS))
    ids = bpe.encode(table(spark, root, "documents"), raw, public_tokenizers.PATTERN)
    back = bpe.decode(ids, raw, public_tokenizers.PATTERN)
    return back.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_alignment(spark: SparkSession, root: str) -> DataFrame:
    return align.aligned_tokens(table(spark, root, "documents"), *(align.file_bytes(public_tokenizers.path(name)) for name in SIDES))


def op12_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return rules.decided(table(spark, root, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "base_failed", "kept")


QUERIES = {"op1_top_k": op1_top_k, "op2_packing": op2_packing, "op3_quality": op3_quality, "op4_near_duplicates": op4_near_duplicates, "op5_fingerprints": op5_fingerprints, "op6_warc": op6_warc, "op7_repeated_passages": op7_repeated_passages, "op8_url_filter": op8_url_filter, "op9_toxicity": op9_toxicity, "op10_bpe": op10_bpe,
           "op11_alignment": op11_alignment, "op12_hard_negatives": op12_hard_negatives, "op13_quality_rules": op13_quality_rules}
SQL = {"op1_top_k": topk.SQL, "op4_near_duplicates": neardup.SQL, "op6_warc": warc.SQL, "op7_repeated_passages": substring.SQL, "op8_url_filter": urls.sql(), "op12_hard_negatives": negatives.SQL, "op13_quality_rules": rules.sql()}

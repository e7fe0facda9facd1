"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.store import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP = 1 << 24  #: most bits of the bitmap that is sent to all tasks


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shelved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a new folder below the cluster's shared checkpoint folder and scan it: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/barloom-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def parts_for(rows: int, rows_per_part: int, least: int = 1) -> int:
    """Number of parts that keeps each near ``rows_per_part``, whatever the table's size."""
    return max(least, math.ceil(rows / rows_per_part))


def salted(key: Column | str, rows: int, rows_per_part: int) -> Column:
    """Part number of a row by the hash of a near-unique key."""
    return F.pmod(F.xxhash64(key), F.lit(parts_for(rows, rows_per_part))).cast("int")


def _marked(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` beside ``__marks`` and ``__bit``, by a broadcast bitmap of hashes: bit ``__bit`` of ``__marks`` is set for every ``key`` in ``ids``, and for few others
    up to a sixteenth of ``BITMAP`` ids, more above."""
    bits = min(BITMAP, 1 << (16 * ids.count() + 64).bit_length())
    at = F.pmod(F.xxhash64(F.lit(11), key), F.lit(bits))
    marked = ids.select(F.floor(at / 64).alias("__word"), F.pmod(at, F.lit(64)).cast("int").alias("bit")).selectExpr("__word", "shiftleft(1L, bit) AS mark")
    words = marked.groupBy("__word").agg(F.bit_or("mark").alias("__marks"))
    return rows.withColumns({"__word": F.floor(at / 64), "__bit": F.pmod(at, F.lit(64)).cast("int")}).join(F.broadcast(words), "__word", how)


def likely(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``ids``; none of ``ids`` is lost. A join that follows moves less."""
    return _marked(rows, ids, key, "inner").filter(F.expr("shiftright(__marks, __bit) & 1 = 1")).select(*rows.columns)


def parted(rows: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``likely`` rows, and all others: their ``key`` is certainly not in ``ids``, so that they can stay where they are."""
    others = _marked(rows, ids, key, "left").filter(F.expr("coalesce(shiftright(__marks, __bit) & 1, 0) = 0"))
    return likely(rows, ids, key), others.select(*rows.columns)

"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import shelved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node that each node of ``edges`` (a, b) reaches; nodes without an edge are not listed.

    Large star: every greater neighbour of a node points to the least node around it; small star: so do its lesser neighbours and itself.
    Repeated until only stars are left: no node points to two others, none is both centre and ray. Hubs are reduced map-side (minimum)
    before any join.
    """
    e = shelved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("ray"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("ray"), F.lit(1).alias("centre")))
        if ends.groupBy("x").agg(F.sum("ray").alias("rays"), F.max("centre").alias("centre")).filter("rays + centre > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = shelved(small, "edges")

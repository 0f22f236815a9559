"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of every u."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is linked to the smallest of them."""
    least = _least(edges)
    hops = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hops.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: their number and two hashes, combined so that nothing can overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component. Nodes without an edge, and labels themselves, are left out."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = checkpointed(e)
    mark = _mark(e)
    while mark[0]:
        e = checkpointed(_small(_large(e)))
        if (now := _mark(e)) == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))

"""Connected components by alternating star operations (every step one aggregation and one join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node it reaches, for every node of the ``a``-``b`` edges.

    Large stars link the larger neighbours of a node to its smallest one, small stars the smaller ones; the
    number of edges never grows, and they end as stars around the smallest nodes.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, mark = _settled(kept)
    while mark[0]:
        both = kept.select("u", "v").unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = (small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
                 .select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        kept, now = _settled(small)
        if now == mark:
            break
        mark = now
    return kept.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        kept.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = written(edges)
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first()
    return edges, tuple(row)

"""Connected components by alternating large and small stars; every round is written, and the one before removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch


def _stars(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """One large star and one small star over pairs (u, v) with u > v.

    Sums by node are written before they are joined back: then both sides of a join come from an exchange,
    and Spark can split what a hub brings.
    """
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    hung = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = scratch.keep(hung.unionAll(low.filter("u > m").select("u", F.col("m").alias("v"))))
    least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = scratch.keep(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    scratch.drop(low, large, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the least node reachable.

    Loops, repeated and reversed edges do no harm; an empty table gives an empty result. Rows are
    bounded by the number of edges, and a hub is a key of a plain join, which can be split.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(pairs)
    while before[0]:
        old, pairs = pairs, _stars(pairs, scratch)
        scratch.drop(old)
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

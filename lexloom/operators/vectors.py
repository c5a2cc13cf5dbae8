"""Vectors as arrays: cosine, centroids and the greedy dedup of a document's passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

DEDUP_THRESHOLD = 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, a_length: Column | None = None, b_length: Column | None = None) -> Column:
    """0 where either vector is zero. Lengths that the caller knows are not computed again."""
    lengths = (length(a) if a_length is None else a_length) * (length(b) if b_length is None else b_length)
    return T.let(lengths, lambda n: F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def greedy_dedup(vectors: Column, threshold: float = DEDUP_THRESHOLD) -> Column:
    """Positions that stay of an array of vectors: those no nearer than the threshold to one that stayed before."""

    def step(kept: Column, v: Column) -> Column:
        near = F.exists(kept, lambda k: (k["i"] >= 0) & (cosine(k["v"], v["v"]) > F.lit(threshold)))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(v)))

    items = F.transform(vectors, lambda v, i: F.struct(i.alias("i"), v.cast("array<double>").alias("v")))
    empty = F.array().cast("array<struct<i:int,v:array<double>>>")
    return F.transform(F.aggregate(items, empty, step), lambda k: k["i"])


def centroids(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, dim, mean): sums are combined before the shuffle."""
    return vectors.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def adjacent(vectors: Column, lengths: Column | None = None) -> Column:
    """Cosines of each vector and the next. lengths: those of all vectors, if the caller knows them."""

    def near(p: Column) -> Column:
        pairs = F.when(F.size(p["v"]) > 1, F.sequence(F.lit(0), F.size(p["v"]) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(pairs, lambda i: cosine(F.get(p["v"], i), F.get(p["v"], i + 1), F.get(p["n"], i), F.get(p["n"], i + 1)))

    known = F.transform(vectors, length) if lengths is None else lengths
    return T.let(F.struct(vectors.alias("v"), known.alias("n")), near)

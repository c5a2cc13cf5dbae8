"""Sparse vectors as columns: array<struct<i, v>> with ascending places, and what is computed with them, all in the JVM.

hashed() is the embedder of models.hashing_embedder() without its scaling: signed counts of hashed words. Its values are
whole numbers, so sums and products are exact in any order and another engine finds the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T

DIM = 256


def _runs(sorted_: Column) -> Column:
    """array<struct<b, e>>: where runs of equal numbers begin and end in a sorted array."""
    begins = F.filter(F.transform(sorted_, lambda x, i: F.when((i == 0) | (F.get(sorted_, i - 1) != x), i)), lambda i: i.isNotNull())
    return T.let(begins, lambda bs: F.transform(bs, lambda b, k: F.struct(b.alias("b"), F.coalesce(F.get(bs, k + 1), F.size(sorted_)).alias("e"))))


def hashed(text: Column, dim: int = DIM) -> Column:
    """The sparse vector of a text's words in lower case: a word's hash gives its place and its sign.

    Places whose words cancel have no entry. A null text has none at all.
    """

    def keyed(word: Column) -> Column:
        h = F.crc32(word.cast("binary"))
        return (h % dim * 2 + F.shiftright(h, 31)).cast("int")

    def vector(keys: Column) -> Column:
        """Of sorted keys, the place twice and the sign."""
        places = F.transform(keys, lambda k: F.shiftright(k, 1))
        signed = lambda r: F.aggregate(F.slice(keys, r["b"] + 1, r["e"] - r["b"]), F.lit(0), lambda a, k: a + k.bitwiseAND(F.lit(1)) * 2 - 1)
        sums = T.let(places, lambda ps: F.transform(_runs(ps), lambda r: F.struct(F.get(ps, r["b"]).alias("i"), signed(r).cast("double").alias("v"))))
        return F.filter(sums, lambda x: x["v"] != 0)

    words = T.tokens(F.lower(F.coalesce(text, F.lit(""))))
    return T.let(F.sort_array(F.transform(words, keyed)), vector)


def dot(a: Column, b: Column) -> Column:
    """Both arrays merged by place; neighbours of equal places are a pair, as a place occurs once in each."""

    def walk(xs: Column) -> Column:
        product = lambda s, x, i: s + F.when(F.get(xs, i - 1)["i"] == x["i"], F.get(xs, i - 1)["v"] * x["v"]).otherwise(0.0)
        pairs = F.transform(xs, lambda x, i: product(F.lit(0.0), x, i))
        return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))

    return T.let(F.sort_array(F.concat(a, b)), walk)


def square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["v"] * x["v"])


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""

    def scaled(p: Column) -> Column:
        return T.let(F.sqrt(square(p["a"]) * square(p["b"])), lambda n: F.when(n == 0, 0.0).otherwise(dot(p["a"], p["b"]) / n))

    return T.let(F.struct(a.alias("a"), b.alias("b")), scaled)


def dense(a: Column, dim: int = DIM) -> Column:
    """The same vector as an array of dim numbers."""
    return T.let(F.struct(F.transform(a, lambda x: x["i"]).alias("i"), F.transform(a, lambda x: x["v"]).alias("v")), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.get(p["v"], F.array_position(p["i"], k).cast("int") - 1), F.lit(0.0))))

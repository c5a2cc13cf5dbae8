"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Each document's lines that hold a word are hashed in overlapping windows of three. A window that
occurs anywhere before, by (document, position), is a later occurrence: its lines, and blank lines
between them, go. Windows that overlap merge their positions.

Plan: one narrow pass makes (hash, document, position) rows, which are written to the shared folder; counts and
first places are summed before the shuffle; only hashes found twice are joined back. That join has no aggregate on the hash
above it, so a hot window's partition can be split at run time. Positions are gathered by document,
which its own length bounds. The text moves once, for the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, let, put

WINDOW = 3


def _filled(lines: Column) -> Column:
    """(line, its position) of the lines with a word."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(F.trim(x, F.lit(" \t\x0b\x0c\r")).alias("s"), i.alias("i"))), lambda x: x["s"] != "")


def _windows(lines: Column) -> Column:
    """A struct for each window: 128 bits of hash, its number, and its first and last line."""

    def made(f: Column) -> Column:
        def one(k: Column) -> Column:
            a, b, c = (F.get(f, k + j) for j in range(WINDOW))
            return F.struct(
                F.xxhash64(a["s"], b["s"], c["s"]).alias("h1"),
                F.xxhash64(F.lit(1), c["s"], a["s"], b["s"]).alias("h2"),
                a["i"].alias("first"),
                c["i"].alias("last"),
            )

        return F.when(F.size(f) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(f) - WINDOW), one))

    return let(_filled(lines), made)


def _kept(lines: Column, spans: Column) -> Column:
    """The lines that no span covers. spans: (first, last), by first; each is of few lines and none holds another."""

    def merged(sorted_spans: Column) -> Column:
        """Disjoint stretches of lines to keep, as (from, length), from merged spans."""
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<a:int,n:int>>").alias("out"))
        walked = F.aggregate(
            sorted_spans,
            start,
            lambda acc, x: F.struct(
                F.greatest(acc["next"], x["last"] + 1).alias("next"),
                F.when(
                    x["first"] > acc["next"],
                    F.concat(acc["out"], F.array(F.struct(acc["next"].alias("a"), (x["first"] - acc["next"]).alias("n")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )
        return let(walked, lambda w: F.concat(w["out"], F.array(F.struct(w["next"].alias("a"), F.greatest(F.lit(0), F.size(lines) - w["next"]).alias("n")))))

    return F.flatten(F.transform(merged(F.sort_array(spans)), lambda r: F.slice(lines, r["a"] + 1, r["n"])))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that stays, n_lines (lines with a word) and n_removed (of those).

    Order is that of the key, then of the position; a null key comes before all others. Rows equal in
    key and text are one document and get the same text. Two texts under one key are ordered by their
    hash. A null text stays null with no lines, a text of fewer than three lines with a word stays as it
    is, and so does every document that loses nothing, to the byte. A document that loses all its lines
    has the empty text. Columns named n_lines or n_removed in the input give way.
    """
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    keyed = put(docs, __k=F.struct(k.alias("a"), F.xxhash64(t).alias("b")))
    rows = (
        keyed.select("__k", F.explode(_windows(F.split(t, "\n"))).alias("w"))
        .select("__k", "w.h1", "w.h2", "w.first", "w.last")
    )
    rows = Scratch(docs.sparkSession).keep(rows)  # both sides of the join read them: the texts are cut and hashed once
    place = F.struct("__k", "first")
    repeated = rows.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.max(place).alias("latest")).filter(F.col("origin") != F.col("latest")).select("h1", "h2", "origin")
    later = rows.join(repeated, ["h1", "h2"]).filter(place != F.col("origin"))
    spans = later.groupBy("__k").agg(F.collect_set(F.struct("first", "last")).alias("__spans"))
    found = keyed.join(spans, keyed["__k"].eqNullSafe(spans["__k"]), "left").drop(spans["__k"])
    n_lines = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    total = F.coalesce(F.when(t.isNotNull(), n_lines(F.split(t, "\n"))), F.lit(0)).cast("bigint")
    rest = let(F.split(t, "\n"), lambda lines: let(_kept(lines, F.col("__spans")), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), n_lines(kept).alias("n"))))
    changed = put(found, __rest=F.when(F.col("__spans").isNotNull(), rest), n_lines=total)
    out = put(changed, **{text: F.coalesce(F.col("__rest.text"), t)}, n_removed=F.coalesce(F.col("n_lines") - F.col("__rest.n"), F.lit(0)).cast("bigint"))
    return out.drop("__k", "__spans", "__rest")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without later occurrences, with its own columns; n_chars, where there is one, follows the text.

    Documents of which nothing with a word is left go, unless they had no line to lose.
    """
    held = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)], F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    done = dedup_lines(held, "__key", "__text").filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    cols = []
    for i, (c, kind) in enumerate(docs.dtypes):
        value = F.col(f"__{i}")
        if c == text:
            value = F.col("__text")
        elif c == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("__text").cast(kind)).otherwise(value)
        cols.append(value.alias(c))
    return done.select(*cols)

"""Operators on a document's lines: frequency-based removal, exact and normalised dedup, and the whole cleaner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.functions import text as T


@T.bound
def remove_repeated_lines(text: Column, threshold: float = 0.5, max_removed: float = 0.2) -> Column:
    """Text without boilerplate lines that make up a share of threshold or more of the filled lines.

    A canonical form is boilerplate if any of its lines is. Text stays as it is if nothing qualifies or if
    more than max_removed of the lines would go; text without a filled line becomes empty. So where a form has to
    make up more than may go, as by default, no line does, and none is looked at.
    """
    if threshold > max_removed:
        return F.when(T.strip(text) == "", "").otherwise(text)
    filled = F.filter(F.transform(T.lines(text), T.strip), lambda x: x != "")

    def judged(ls: Column) -> Column:
        marked = F.transform(ls, lambda x: F.struct(x.alias("s"), N.canonical(x).alias("k")))

        def cut(ms: Column) -> Column:
            told = lambda k: F.exists(ms, lambda m: (m["k"] == k) & P.boilerplate(m["s"]))
            often = F.filter(frequent(F.transform(ms, lambda m: m["k"]), threshold), told)  # few reach the threshold, and only they are asked
            kept = lambda o: F.filter(ms, lambda m: ~F.array_contains(o, m["k"]))
            done = lambda o: T.let(
                kept(o),
                lambda r: F.when(F.lit(1.0) - F.size(r) / F.size(ms) > F.lit(max_removed), text).otherwise(F.array_join(F.transform(r, lambda m: m["s"]), "\n")),
            )
            return T.let(often, lambda o: F.when(F.size(o) == 0, text).otherwise(done(o)))

        return F.when(F.size(ls) == 0, "").otherwise(T.let(marked, cut))

    return T.let(filled, judged)


def frequent(keys: Column, share: float) -> Column:
    """The distinct keys that make up that share of an array or more: one sort, then the lengths of its runs."""

    def runs(ks: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ks) - 1), lambda i: (i == 0) | (F.get(ks, i) != F.get(ks, i - 1)))
        long = lambda bs: F.filter(
            F.transform(bs, lambda b, j: F.struct(b.alias("b"), (F.coalesce(F.get(bs, j + 1), F.size(ks)) - b).alias("n"))),
            lambda r: r["n"] / F.size(ks) >= F.lit(share),
        )
        return F.transform(T.let(begins, long), lambda r: F.get(ks, r["b"]))

    return T.let(F.sort_array(keys), runs)


def first_lines(text: Column, key=lambda s: s) -> Column:
    """Text without filled lines whose key occurred before; blank lines stay. Lines are sorted by key and place,
    where a line that follows its like is a repeat, and back by place.
    """

    def kept(ls: Column) -> Column:
        keyed = F.transform(ls, lambda x, i: F.struct(T.let(T.strip(x), lambda s: F.when(s != "", key(s))).alias("k"), i.alias("i")))
        repeats = lambda ks: F.transform(
            ks, lambda k, j: F.struct(k["i"].alias("i"), F.coalesce((j > 0) & (F.get(ks, j - 1)["k"] == k["k"]), F.lit(False)).alias("again"))
        )
        placed = F.sort_array(T.let(F.sort_array(keyed), repeats))
        return T.let(placed, lambda p: F.array_join(F.filter(ls, lambda x, i: ~F.get(p, i)["again"]), "\n"))

    return T.let(F.split(text, "\n"), kept)


def loose_key(s: Column) -> Column:
    """Lower case without punctuation."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x{85}\p{Z}]", "")


def drop_lines(text: Column, keep) -> Column:
    return F.array_join(F.filter(T.lines(text), keep), "\n")


def clean(text: Column, decomposed: Column | None = None, keep_newlines: bool = False) -> Column:
    """The whole cleaner, step by step. decomposed: the text after opening(), normalised to NFKD by the caller.

    Control characters go halfway, newlines with them, so later line steps see the document as one line;
    keep_newlines is the opt-in repair.
    """
    c = N.nfkd(opening(text)) if decomposed is None else decomposed
    c = F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f\x7f]", "") if keep_newlines else N.strip_control(c)
    c = drop_lines(c, P.symbol_line_ok)
    c = remove_repeated_lines(c)
    c = drop_lines(c, lambda x: ~P.data_row(T.strip(x)))
    c = N.ligatures(c)
    kept = F.filter(T.lines(c), lambda x: ~P.page_number(x))
    return N.per_paragraph(N.paragraphs(kept))


def opening(text: Column) -> Column:
    """The cleaner's steps before normalisation; after_stops() is the end of missing_spaces() and finds nothing more."""
    return N.dehyphenate(N.missing_spaces(N.newlines(F.coalesce(text, F.lit("")))))


def clean_documents(docs: DataFrame, text: str = "text", to: str = "clean", keep_newlines: bool = False) -> DataFrame:
    """docs with the cleaned text, inside the JVM; what NFKD gives is a column of its own, so that it is computed once."""
    return (
        docs.withColumn("__nfkd", N.nfkd(opening(F.col(text))))
        .withColumn(to, clean(F.col(text), F.col("__nfkd"), keep_newlines))
        .drop("__nfkd")
    )

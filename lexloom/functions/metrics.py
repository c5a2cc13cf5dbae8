"""Scores of a summary against its original, unrounded unless rounded() is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import normalize as N
from lexloom.functions import text as T

# Words that carry no content.
COMMON = (
    "the a an and of to in for on with by is are was were be been being have has had having do does did doing but or so nor yet at from into through during "
    "including without within this that these those there their they will would could should may might must can cannot not no yes also very just such each both only "
    "over under then than when where which while because using like enable perform process provide use based study research paper article find found show"
).split()
WORD = r"[a-zA-Z]+(?:-[a-zA-Z]+)?"
TERM = r"[a-zA-Z]{4,}"
#: What is neither in a word nor white space.
NO_WORD = "[^" + T.QUICK["w"] + T.QUICK["s"] + "]"


def syllables(word: Column) -> Column:
    """Groups of vowels of a word of plain letters and hyphens, less a final e, at least one; one for three letters or fewer."""

    def counted(w: Column) -> Column:
        groups = F.regexp_count(w, F.lit("[aeiouy]+"))
        return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0), F.lit(1)))

    return T.let(F.replace(F.lower(word), F.lit("-"), F.lit("")), counted)


def all_syllables(words: Column) -> Column:
    """syllables() of an array of words, summed: one each, and of words of over three letters the groups of vowels behind the
    first, but not one that ends the word with an e.
    """
    joined = F.concat(F.lit(" "), F.replace(F.lower(F.array_join(words, " ")), F.lit("-"), F.lit("")))
    later = F.regexp_replace(joined, " (?:[^ ]{1,3}(?![^ ])|[^aeiouy ]*+[aeiouy]++)", " ")
    return F.size(words) + F.regexp_count(later, F.lit("[aeiouy]++(?:(?<!e)|(?=[^ ]))"))


def _sentences(normal: Column, over: int) -> Column:
    return F.filter(F.transform(F.split(normal, "[.!?]+"), T.strip), lambda x: F.length(x) > over)


@T.bound
def flesch(text: Column) -> Column:
    """Reading ease, between 0 and 100; 50 where there is too little text."""

    def scored(normal: Column) -> Column:
        words = F.regexp_extract_all(T.plain_words(normal), F.lit(WORD), F.lit(0))

        def ease(w: Column) -> Column:
            n_words, n_sentences = F.size(w), F.size(_sentences(normal, 5))
            sounds = all_syllables(w)
            value = F.lit(206.835) - F.lit(1.015) * (n_words / n_sentences) - F.lit(84.6) * (sounds / F.greatest(n_words, F.lit(1)))
            return F.when((n_sentences == 0) | (n_words < 10), 50.0).otherwise(T.capped(value, 0.0, 100.0))

        return T.let(words, ease)

    return F.when(F.coalesce(F.length(T.strip(text)) < 50, F.lit(True)), 50.0).otherwise(T.let(N.bullets(text), scored))


def content_words(text: Column) -> Column:
    bare = F.split(T.replace(F.lower(text), NO_WORD, ""), T.java("{s}+"))
    return F.filter(F.array_distinct(bare), lambda x: (F.length(x) >= 3) & ~x.isin(COMMON))


@T.bound2
def coverage(original: Column, summary: Column) -> Column:
    """Share of the original's content words that the summary has, times 1.3, at most 1."""
    share = T.let(content_words(original), lambda o: F.when(F.size(o) == 0, 0.5).otherwise(T.capped(F.size(F.array_intersect(o, content_words(summary))) / F.size(o) * F.lit(1.3))))
    return F.when(F.coalesce((original == "") | (summary == ""), F.lit(True)), 0.0).otherwise(share)


@T.bound
def redundancy(summary: Column) -> Column:
    """Share of sentences that repeat an earlier one; 0 under fifty words or two sentences."""
    found = F.transform(_sentences(N.bullets(summary), 15), F.lower)
    share = T.let(found, lambda s: F.when(F.size(s) < 2, 0.0).otherwise((F.size(s) - F.size(F.array_distinct(s))) / F.size(s)))
    return F.when(F.coalesce(T.count_tokens(summary) < 50, F.lit(True)), 0.0).otherwise(share)


@T.bound
def density(summary: Column) -> Column:
    terms = F.size(F.array_distinct(F.regexp_extract_all(T.plain_words(F.lower(summary)), F.lit(TERM), F.lit(0))))
    return T.let(T.count_tokens(summary), lambda n: F.when(F.coalesce(n == 0, F.lit(True)), 0.0).otherwise(T.capped(terms / n * F.lit(2.0))))


def _compression(original_words: Column, summary_words: Column) -> Column:
    return original_words / F.greatest(summary_words, F.lit(1))


def compression(original: Column, summary: Column) -> Column:
    return _compression(T.count_tokens(original), T.count_tokens(summary))


def compression_score(ratio: Column) -> Column:
    return T.capped(ratio / F.lit(5.0))


def _length_penalty(original_words: Column, summary_words: Column) -> Column:
    ratio = summary_words / F.greatest(original_words, F.lit(1))
    return T.capped(F.lit(1.0) - F.abs(ratio - F.lit(0.15)) * F.lit(3.0))


def length_penalty(original: Column, summary: Column) -> Column:
    """1 where the summary has 15 % of the words, falling threefold with the distance from it."""
    return _length_penalty(T.count_tokens(original), T.count_tokens(summary))


def overall(cosine: Column, cover: Column, ratio: Column, dense: Column, redundant: Column, penalty: Column) -> Column:
    parts = (
        cosine * F.lit(0.20)
        + cover * F.lit(0.25)
        + compression_score(ratio) * F.lit(0.20)
        + dense * F.lit(0.15)
        + (F.lit(1.0) - F.least(F.lit(0.3), redundant)) * F.lit(0.10)
        + penalty * F.lit(0.10)
    )
    return T.capped(parts)


@T.bound2
def evaluate(original: Column, summary: Column, cosine: Column | None = None, rounded: bool = False, words: Column | None = None) -> Column:
    """All scores as one struct. Of an empty pair: zeros and a reading ease of 50, the rest null. words: the original's, if
    they are counted already.
    """
    cosine = F.lit(0.5) if cosine is None else cosine
    r = lambda x, n: F.bround(x, n) if rounded else x
    raw = lambda n: F.struct(
        n["o"].alias("o"), n["s"].alias("s"), cosine.alias("cos"), _compression(n["o"], n["s"]).alias("ratio"), coverage(original, summary).alias("cover"), redundancy(summary).alias("red"),
        density(summary).alias("dense"), flesch(summary).alias("ease"), _length_penalty(n["o"], n["s"]).alias("pen"),
    )
    empty = F.coalesce((original == "") | (summary == ""), F.lit(True))

    def made(s: Column) -> Column:
        zero = lambda x: F.when(empty, 0.0).otherwise(x)
        return F.struct(
            zero(r(s["cos"], 4)).alias("cosine_similarity"),
            zero(r(s["ratio"], 2)).alias("compression_ratio"),
            zero(r(s["cover"], 4)).alias("coverage"),
            zero(r(overall(s["cos"], r(s["cover"], 4), s["ratio"], r(s["dense"], 4), r(s["red"], 4), s["pen"]), 4)).alias("overall_score"),
            F.when(empty, 50.0).otherwise(r(s["ease"], 2)).alias("readability_flesch"),
            zero(r(s["red"], 4)).alias("redundancy"),
            zero(r(s["dense"], 4)).alias("density"),
            F.when(~empty, r(s["pen"], 4)).alias("length_penalty"),
            F.when(~empty, s["o"]).alias("original_words"),
            F.when(~empty, s["s"]).alias("summary_words"),
            F.when(~empty, F.when(s["ratio"] > 0, F.concat(F.format_string("%.1f", F.bround(F.lit(100.0) / s["ratio"], 1)), F.lit("%"))).otherwise("0%")).alias("compression_percent"),
        )

    counts = F.struct((T.count_tokens(original) if words is None else words).alias("o"), T.count_tokens(summary).alias("s"))
    return T.let(T.let(counts, raw), made)

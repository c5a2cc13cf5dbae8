"""Document type from two scores, each a sum of doubles in a fixed order."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T

# The detector's patterns. A heading is anchored at the text's start or right behind a newline.
BOOK_PATTERNS = [
    r"(?i)(?:\n|^)(?:Chapter|Ch\.){s}+{d}+",
    r"(?i)(?:\n|^)Part{s}+{w}+",
    r"(?i)(?:\n|^)Unit{s}+{d}+",
    r"(?i)(?:\n|^)CONTENTS?{s}*\n",
    r"(?i)(?:\n|^)Table of Contents",
]
CHAPTER_NUMBER = r"(?:Chapter|CHAPTER|Ch\.){s}+({d}+)"
CONTENTS = r"(?i)CONTENTS"
PAPER_SECTIONS = ["Abstract", "Introduction", "Methodology", "Results?", "Discussion", "Conclusion", "References?", "Related Work"]
SECTION = r"(?i)(?:\n|^){name}(?:{W}|$)"
WHOLE_WORD = r"(?i)(?:^|{W}){name}(?:{W}|$)"
LONG_ABSTRACT = r"(?i)Abstract{s}*\n{s}*[A-Z][^A-Za-z]{100,}"
AUTHORS = [r"(?:Author|By):{s}+[A-Z][a-z]+{s}+[A-Z][a-z]+", r"[A-Z][a-z]+{s}+[A-Z][a-z]+,{s}+{d}+", r"Department of{s}+{w}+"]
WORDS_PER_PAGE = 300
#: What a text's lines must have at their beginning for any heading of a kind to be found. Most texts have none.
BOOK_HEADS = r"(?i)\n(?:ch(?:apter|\.)|part|unit|content|table of contents)"
PAPER_HEADS = r"(?i)\n(?:abstract|introduction|methodology|result|discussion|conclusion|reference|related work)"


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def pages(words: Column) -> Column:
    return words / F.lit(float(WORDS_PER_PAGE))


def _headed(pattern: str) -> str:
    """A pattern for "\\n" + text that finds what pattern finds in text: no place but a newline is looked at."""
    return pattern.replace(r"(?:\n|^)", r"\n")


def _whole_word(name: str) -> str:
    """WHOLE_WORD from the name's first letter on; a word character before it has one code unit or two."""
    return rf"(?i){name[0]}(?<!{{w}}{name[0]}|{{w}}{{w}}{name[0]}){name[1:]}(?:{{W}}|$)"


def _any(text: Column, *some: str) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in some))


def consecutive(text: Column) -> Column:
    """Whether the first ten chapter numbers, of which there are two or more, count up by one."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit(T.java(CHAPTER_NUMBER.replace("(?:Chapter|CHAPTER|Ch", "C(?:hapter|HAPTER|h"))), F.lit(1)), 1, 10), lambda x: x.cast("decimal(38,0)"))
    return T.let(found, lambda n: (F.size(n) > 1) & F.coalesce(F.forall(F.transform(n, lambda x, i: x == n[0] + i), lambda ok: ok), F.lit(False)))


@T.bound2
def book_score(text: Column, n_pages: Column) -> Column:
    length = F.when(n_pages >= 100, 0.3).when(n_pages >= 50, 0.2).when(n_pages >= 30, 0.1).otherwise(0.0)
    counted = lambda t: F.when(T.has(t, BOOK_HEADS), sum((T.count_of(t, _headed(p)) for p in BOOK_PATTERNS), F.lit(0))).otherwise(0)
    hits = T.let(F.concat(F.lit("\n"), text), counted)
    chapters = T.let(hits, lambda h: F.when(h >= 5, 0.4).when(h >= 3, 0.3).when(h >= 1, 0.15).otherwise(0.0))
    return F.least(length + chapters + _points(F.when(_any(text, "Chapter", "CHAPTER", "Ch."), consecutive(text)).otherwise(False), 0.2) + _points(T.has(text, CONTENTS), 0.1), F.lit(1.0))


@T.bound
def paper_score(text: Column) -> Column:
    counted = lambda t: F.when(T.has(t, PAPER_HEADS), sum((T.has(t, _headed(SECTION.replace("{name}", f"(?:{s})"))).cast("int") for s in PAPER_SECTIONS), F.lit(0))).otherwise(0)
    sections = T.let(F.concat(F.lit("\n"), text), counted)
    score = sections / F.lit(8.0) * F.lit(0.5)
    word = lambda name: T.has(text, _whole_word(name))
    both = lambda low: F.struct(
        F.when(F.contains(low, F.lit("abstract")) & word("Abstract"), F.when(T.has(text, LONG_ABSTRACT), 0.25).otherwise(0.1)).otherwise(0.0).alias("abstract"),
        _points(F.contains(low, F.lit("reference")) & word("References?"), 0.15).alias("references"),
    )
    score = T.let(T.let(F.lower(text), both), lambda p: score + p["abstract"] + p["references"])
    for pattern, first in zip(AUTHORS, (_any(text, "Author:", "By:"), T.has(text, ",{s}+{d}"), _any(text, "Department of")), strict=True):
        score = score + _points(first & T.has(text, pattern), 0.05)
    return F.least(score, F.lit(1.0))


def kind_of(book: Column, paper: Column) -> Column:
    return F.when((book > F.lit(0.6)) & (book > paper), "book").when(paper > F.lit(0.5), "paper").otherwise("general")


@T.bound
def detection(text: Column, digits: int | None = 2, words: Column | None = None) -> Column:
    """struct(type, confidence, metadata(pages, words, has_chapters, has_abstract)); digits None leaves numbers as they are.
    words: how many the text has, if they are counted already.
    """
    rounded = lambda x, n: F.bround(x, n) if digits is not None else x

    def made(s: Column) -> Column:
        kind = kind_of(s["book"], s["paper"])
        sure = F.when(kind == "book", s["book"]).when(kind == "paper", s["paper"]).otherwise(F.lit(1.0) - F.greatest(s["book"], s["paper"]))
        return F.struct(
            kind.alias("type"),
            rounded(sure, digits).alias("confidence"),
            F.struct(
                rounded(pages(s["words"]), 1).alias("pages"),
                s["words"].alias("words"),
                F.when(kind == "book", s["book"] > F.lit(0.7)).alias("has_chapters"),
                F.when(kind == "paper", s["paper"] > F.lit(0.7)).alias("has_abstract"),
            ).alias("metadata"),
        )

    scored = T.let(T.count_tokens(text) if words is None else words, lambda w: F.struct(w.alias("words"), book_score(text, pages(w)).alias("book"), paper_score(text).alias("paper")))
    return T.let(scored, made)

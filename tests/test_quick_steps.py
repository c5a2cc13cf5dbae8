"""Steps that are written for speed, held against the patterns that define them."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import detect
from lexloom.functions import normalize as N
from lexloom.functions import text as T
from lexloom.operators import lines

BITS = ["a", "Bz", "Z", ".", ",", "!", "?", "-", " ", "\n", "\r", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "0", "59", "_", "é", "٣", "\U0001d400", "\U0001d7d9", "中", "²",
        "wo-\nrd", "- \n ", "\nPart x", "Chapter 1", "\nchapter 2", "CHAPTER 3", "Ch. 4", "CONTENTS\n", "\nAbstract\n", "abstract", "References", "of ce", "Speci c", "DE NED", "ſpeci c", "Made with Gamma", "the end. Next"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    return spark.createDataFrame([("".join(rng.choices(BITS, k=rng.choice([0, 1, 2, 5, 30]))),) for _ in range(3000)], "t string")


def differ(odd, a, b):
    return odd.select("t", a.alias("a"), b.alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).take(3)


def test_cleaner_steps(odd):
    t = F.col("t")
    steps = [*N.NEWLINES, *N.MISSING_SPACES, *N.AFTER_STOPS, *N.DEHYPHENATE]
    assert len(N.SPACED) < len(N.MISSING_SPACES)
    assert not differ(odd, T.chain(t, steps), lines.opening(t))
    assert not differ(odd, T.chain(t, N.AFTER_STOPS), N.after_stops(t))
    assert not differ(odd, T.chain(t, [(rf"(?iu)(?U)\b{found}\b", whole) for found, whole in N.LIGATURES]), N.ligatures(t))
    all_ = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(T.replace(t, rf"(?:{T.BREAK})\z", ""), T.BREAK))
    assert not differ(odd, all_, T.lines(t))
    assert not differ(odd, F.length(t) - F.length(F.translate(t, T.WS_CHARS, "")), T.chars_of(t, T.WS_CHARS))


def test_detector_patterns(odd):
    t, behind = F.col("t"), F.concat(F.lit("\n"), F.col("t"))
    for p in [*detect.BOOK_PATTERNS, *[detect.SECTION.replace("{name}", f"(?:{s})") for s in detect.PAPER_SECTIONS]]:
        assert not differ(odd, T.count_of(t, p), T.count_of(behind, detect._headed(p)))
    for name in ("Abstract", "References?"):
        assert not differ(odd, T.has(t, detect.WHOLE_WORD.replace("{name}", name)), T.has(t, detect._whole_word(name)))


def test_texts_without_a_heading_are_told_by_one_look(odd):
    t, behind = F.col("t"), F.concat(F.lit("\n"), F.col("t"))
    sections = [detect.SECTION.replace("{name}", f"(?:{s})") for s in detect.PAPER_SECTIONS]
    for heads, patterns in ((detect.BOOK_HEADS, detect.BOOK_PATTERNS), (detect.PAPER_HEADS, sections)):
        found = F.greatest(*(T.has(t, p) for p in patterns))
        assert not odd.filter(found & ~T.has(behind, heads)).take(3)
        assert odd.filter(~T.has(behind, heads)).count() > 500

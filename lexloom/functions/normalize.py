"""String projections: each step is a list of (pattern, replacement), applied in order."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import decompose
from lexloom.functions import text as T

# The operators' patterns and replacements, in their order.
NEWLINES = [(r"\r\n?", "\n")]
AFTER_STOPS = [(r"\.([A-Z])", r". \1"), (r"([.!?])([A-Z])", r"\1 \2"), (r"\.({d})", r". \1"), (r",([A-Za-z])", r", \1")]
MISSING_SPACES = [
    (r"({d})([A-Za-z])", r"\1 \2"),
    (r"([A-Za-z])({d})([A-Za-z])", r"\1 \2\3"),
    (r"Made with Gamma", "Made with Gamma "),
    (r"\.({d})([A-Za-z])", r".\1 \2"),
    *AFTER_STOPS,
]
DEHYPHENATE = [(r"({w}+)-{s}*\n{s}*({w}+)", r"\1\2")]
CONTROL = [(r"[\x00-\x1f\x7f]", "")]
CANONICAL = [(r"[^a-z0-9\x09-\x0D\x1C-\x20\x{85}\p{Z}]", ""), (r"{s}+", " "), (r"^{s}+|{s}+$", "")]
LIGATURES = [
    ("speci ed", "specified"), ("speci c", "specific"), ("speci cation", "specification"), ("signi cant", "significant"),
    ("identi ed", "identified"), ("classi cation", "classification"), ("de nition", "definition"), ("de ned", "defined"),
    ("de nes", "defines"), ("con guration", "configuration"), ("in nite", "infinite"), ("ef cient", "efficient"),
    ("ef ort", "effort"), ("di erent", "different"), ("of ce", "office"),
]
GLYPHS = [(r"\b0\b", "O"), (r"\b1\b", "I"), (r"\b5\b", "S"), ("rn", "m"), ("cl", "d"), ("vv", "w")]
OCR_CLEAN = [(r"[^\x20-\x7E\n]", " "), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"\.([A-Z])", r". \1"), (r"^{s}+|{s}+$", "")]
CHUNK_CLEAN = [(r"[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x{85}\p{Z}.,;:()\-]", " "), (r"{s}+", " "), (r"^{s}+|{s}+$", "")]
SUMMARY_CLEAN = [(r"\n{4,}", "\n\n"), (r"(###{s}+[^\n]+)\n{1,}", "\\1\n\n"), (r"\.([A-Z])", r". \1"), (r"^{s}+|{s}+$", "")]
READABILITY = [(r"\.([A-Z])", r". \1"), (r":([A-Za-z])", r": \1"), (r"\n{3,}", "\n\n"), (r"^{s}+|{s}+$", "")]
#: CHUNK_CLEAN's first pattern for the JVM, and white space but for a single blank.
ODD_CHARACTER = "[^" + T.QUICK["w"] + T.QUICK["s"] + r".,;:()\-]"
OTHER_BLANKS = r"{s}(?:(?<=[^ ])|{s}){s}*+"
SQUEEZE = [(r"[ \t]+", " "), (r"^{s}+|{s}+$", "")]
BULLET = r"^(?:{s}|[•*\-+.]|{d})+"


#: The steps of MISSING_SPACES and AFTER_STOPS that change anything. The first parts all digits from letters behind them, so
#: two others find none; what holds of a stop and a capital holds of all stops; and a second AFTER_STOPS finds nothing.
SPACED = [MISSING_SPACES[0], MISSING_SPACES[2], *AFTER_STOPS[1:]]
#: The same in one go: each puts a blank behind a character for what follows it, and no two share a character. "Made with
#: Gamma" has none of these characters.
SPACE_BEHIND = (r"[.,!?{d}](?:(?<=[.!?])(?=[A-Z])|(?<=\.)(?={d})|(?<![.!?])(?=[A-Za-z]))", "$0 ")
#: DEHYPHENATE from the hyphen on. Both sides of a match are whole words, so it takes a word character before the hyphen
#: that is not the last match's (of two code units beyond the basic plane).
HYPHEN = [(r"-(?<!\G-)(?<={w}-|{w}{w}-){s}*\n{s}*({w}+)", r"\1")]


def newlines(c: Column) -> Column:
    return T.step(c, ("\r",), *NEWLINES[0])


def missing_spaces(c: Column) -> Column:
    return T.step(F.regexp_replace(c, T.java(SPACE_BEHIND[0]), SPACE_BEHIND[1]), (MISSING_SPACES[2][0],), *MISSING_SPACES[2])


def after_stops(c: Column) -> Column:
    return T.chain(c, AFTER_STOPS[1:])


def dehyphenate(c: Column) -> Column:
    return T.step(c, ("-", "\n"), *HYPHEN[0])


def nfkd(c: Column) -> Column:
    """Compatibility decomposition; plain ASCII texts pass untouched."""
    return decompose.nfkd(c)


def strip_control(c: Column) -> Column:
    return T.chain(c, CONTROL)


def canonical(c: Column) -> Column:
    return T.chain(F.lower(c), CANONICAL)


@T.bound
def ligatures(c: Column) -> Column:
    """The fixes in order, each for texts in which it can find anything."""

    def fixed(low: Column) -> Column:
        odd = F.contains(c, F.lit("\u017f")) | F.contains(c, F.lit("\u212a"))  # which the patterns take for s and k

        def step(x: Column, found: str, whole: str) -> Column:
            return T.let(x, lambda y: F.when(odd | low.contains(found), F.regexp_replace(y, rf"(?iu)(?U)\b{found}\b", whole)).otherwise(y))

        shortest = [x for x, _ in LIGATURES if not any(y != x and y in x for y, _ in LIGATURES)]
        some = functools.reduce(lambda a, x: a | low.contains(x), shortest, odd)
        return F.when(some, functools.reduce(lambda x, fix: step(x, *fix), LIGATURES, c)).otherwise(c)

    return T.let(F.lower(c), fixed)


def glyphs(c: Column) -> Column:
    return T.chain(c, [(f"(?U){p}" if "b" in p else p, to) for p, to in GLYPHS])


def ocr_clean(c: Column) -> Column:
    return T.chain(c, OCR_CLEAN)


def chunk_clean(c: Column) -> Column:
    bare = F.regexp_replace(c, ODD_CHARACTER, " ")
    return T.strip(F.regexp_replace(bare, T.java(OTHER_BLANKS), " "))


def summary_clean(c: Column) -> Column:
    return T.chain(c, SUMMARY_CLEAN)


def readability(c: Column) -> Column:
    return T.chain(c, READABILITY)


def bullets(c: Column) -> Column:
    """Lines without bullets and numbering, each closed by a stop, joined by spaces."""
    bare = F.transform(T.lines(c), lambda x: T.strip(T.replace(T.strip(x), BULLET, "")))
    closed = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.when(T.has(x, r"[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))
    return F.array_join(closed, " ")


def light_cleanup(c: Column) -> Column:
    """Sentences with a fifth or more of plain letters, joined by spaces."""
    parts = F.transform(F.split(c, T.java(r"{s}(?<=[.!?]{s}){s}*")), T.strip)
    letters = lambda x: T.chars_of(x, T.LETTERS)
    return F.array_join(F.filter(parts, lambda x: (x != "") & (letters(x) / F.length(x) >= F.lit(0.2))), " ")


def is_heading(x: Column) -> Column:
    """All capitals; numbered with a capital; or at most six words and a colon at the end."""
    return (
        (T.has(x, r"\p{Lu}") & ~T.has(x, r"[\p{Ll}\p{Lt}]"))
        | T.has(x, r"^{d}+(?:\.{d}+)*{s}+[A-Z]")
        | (x.endswith(":") & (T.count_tokens(x) <= 6))
    )


def paragraphs(all_lines: Column) -> Column:
    """Lines folded to paragraphs. A line opens one if it is a heading, or the line before is blank or ends a sentence."""

    def joined(ls: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.get(ls, i - 1)
            opens = F.coalesce((before == "") | T.has(before, r"[.!?:]$"), F.lit(True)) | is_heading(x)
            return F.when(x == "", "").otherwise(F.concat(F.when(opens, "\n\n").otherwise(" "), x))

        return F.regexp_replace(F.array_join(F.transform(ls, piece), ""), "^\n\n", "")

    return T.let(F.transform(all_lines, T.strip), joined)


def per_paragraph(c: Column) -> Column:
    """light_cleanup() of each paragraph, then runs of blanks squeezed and the ends stripped."""
    done = F.array_join(F.transform(F.split(c, "\n\n"), light_cleanup), "\n\n")
    return T.strip(F.regexp_replace(done, r"[ \t](?:(?<=\t)|[ \t])[ \t]*+", " "))

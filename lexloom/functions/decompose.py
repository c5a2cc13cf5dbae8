"""Compatibility decomposition (NFKD) in the JVM, for which Spark has no function.

Tables are made from the driver's Unicode data when a plan is built and travel in it as constants: a code point is
looked up by its block of 128 and its place there, each an index into an array. Hangul syllables follow a rule. What is
plain ASCII is not looked at, and marks are sorted only where some stand in the wrong order.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T

BLOCK = 7
#: Up to so many different characters are replaced in the whole text, more of them piece by piece.
FEW = 40
SEPARATOR = "\x01"
#: Hangul syllables are numbered by lead, vowel and tail.
SYLLABLES, LEADS, VOWELS, TAILS = (0xAC00, 0xD7A3), (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def _blocks(value) -> tuple[str, str]:
    """Two constants: each block's number among those that hold anything (0: none), and the values of those blocks."""
    numbers, values = [], [""] * (1 << BLOCK)
    for begin in range(0, sys.maxunicode + 1, 1 << BLOCK):
        own = [value(c) for c in range(begin, begin + (1 << BLOCK))]
        numbers.append(len(values) >> BLOCK if any(own) else 0)
        if any(own):
            values += own
    return SEPARATOR.join(map(str, numbers)), SEPARATOR.join(values)


def _decomposed(code: int) -> str:
    if SYLLABLES[0] <= code <= SYLLABLES[1] or 0xD800 <= code <= 0xDFFF:
        return ""
    flat = unicodedata.normalize("NFKD", chr(code))
    return "" if flat == chr(code) else flat


def _class(code: int) -> str:
    return str(unicodedata.combining(chr(code)) or "")


@functools.cache
def tables() -> tuple[tuple[str, str], tuple[str, str], str]:
    """Decompositions, combining classes, and a character class of all marks that have one."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    ranges, begin = [], None
    for c, after in zip(marks, [*marks[1:], None], strict=True):
        begin = c if begin is None else begin
        if after != c + 1:
            ranges.append(f"\\x{{{begin:X}}}-\\x{{{c:X}}}")
            begin = None
    return _blocks(_decomposed), _blocks(_class), "".join(ranges)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _look_up(code: Column, table: tuple[str, str]) -> Column:
    numbers, values = (F.split(F.lit(x), SEPARATOR) for x in table)  # constants, folded once
    return F.get(values, F.get(numbers.cast("array<int>"), F.shiftright(code, BLOCK)) * (1 << BLOCK) + code.bitwiseAND(F.lit((1 << BLOCK) - 1)))


def _jamo(code: Column) -> Column:
    part = lambda first_and_many, i: F.get(F.array(*[F.lit(chr(first_and_many[0] + k)) for k in range(first_and_many[1])]), i.cast("int"))
    s = code - SYLLABLES[0]
    tail = s % TAILS[1]
    lead, vowel = F.floor(s / (VOWELS[1] * TAILS[1])), F.floor(s % (VOWELS[1] * TAILS[1]) / TAILS[1])
    return F.concat(part(LEADS, lead), part(VOWELS, vowel), F.when(tail == 0, "").otherwise(part(TAILS, tail)))


def _character(c: Column) -> Column:
    def one(code: Column) -> Column:
        found = T.let(_look_up(code, tables()[0]), lambda d: F.when(d == "", c).otherwise(d))
        return F.when(code.between(*SYLLABLES), _jamo(code)).otherwise(found)

    return T.let(F.ascii(c), one)


def _in_order(marks: Column) -> Column:
    """A run of marks, sorted by class; those of one class keep their order."""
    keyed = F.transform(_chars(marks), lambda c, i: F.struct(_look_up(F.ascii(c), tables()[1]).cast("int").alias("k"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")


@T.bound
def nfkd(text: Column) -> Column:
    """text decomposed by compatibility, its marks in canonical order; null of a null."""
    marks = tables()[2]
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    by_piece = F.array_join(F.transform(pieces, lambda p: F.when(F.ascii(p) < 128, p).otherwise(_character(p))), "")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    changed = F.filter(F.transform(found, lambda c: F.struct(c.alias("c"), _character(c).alias("to"))), lambda x: x["c"] != x["to"])
    # nothing that a character becomes is changed itself, so a few are replaced one after the other
    flat = T.let(changed, lambda xs: F.when(F.size(xs) <= FEW, F.aggregate(xs, text, lambda t, x: F.replace(t, x["c"], x["to"]))).otherwise(by_piece))

    def ordered(x: Column) -> Column:
        runs = F.regexp_extract_all(x, F.lit(f"(?s)[{marks}]+|[^{marks}]+"), F.lit(0))
        # marks by the JVM's data, with whatever it does not know yet: a cheap test that lets no pair of marks by
        return F.when(x.rlike(r"[\x{300}-\x{10FFFF}&&[\p{M}\p{Cn}]]{2}"), F.array_join(F.transform(runs, lambda r: F.when((F.length(r) > 1) & r.rlike(f"^[{marks}]"), _in_order(r)).otherwise(r)), "")).otherwise(x)

    return F.when(F.octet_length(text) > F.length(text), T.let(flat, ordered)).otherwise(text)

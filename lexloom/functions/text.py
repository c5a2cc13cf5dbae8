"""Column helpers that read text as the operators mean it: white space, words and digits of all scripts.

The character classes are spelled out, so that the JVM's regular expressions and any other engine agree.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes: white space, word characters, decimal digits.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
#: The same white space, character by character.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A step of a chain that strips.
ENDS = (r"^{s}+|{s}+$", "")
#: The same classes for the JVM, which finds single characters of one byte in a table and then asks a range before a property.
QUICK = {
    "s": r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0[\x{1680}-\x{3000}&&\p{Z}]",
    "w": string.ascii_letters + string.digits + r"_[\x{AA}-\x{10FFFF}&&[\p{L}\p{N}]]",
    "d": string.digits + r"[\x{660}-\x{10FFFF}&&\p{Nd}]",
}
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
QUICK_BREAK = r"[\x0A\x0D\x0B\x0C\x1C\x1D\x1E\x85[\x{2028}-\x{2029}]]"


def rx(pattern: str) -> str:
    """A pattern with {s}, {w} and {d} for the classes above ({S} and {W} for all else)."""
    for name, value in (("{s}", WS), ("{w}", WORD), ("{d}", DIGIT), ("{S}", "[^" + WS[1:]), ("{W}", "[^" + WORD[1:])):
        pattern = pattern.replace(name, value)
    return pattern


def java(pattern: str) -> str:
    """rx() with the quick classes: what runs in the JVM."""
    for name, inner in QUICK.items():
        pattern = pattern.replace("{" + name + "}", f"[{inner}]").replace("{" + name.upper() + "}", f"[^{inner}]")
    return pattern


def replace(c: Column, pattern: str, to: str) -> Column:
    """All matches replaced; groups in `to` are written \\1, \\2."""
    groups = to.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3")
    return F.regexp_replace(c, F.lit(java(pattern)), F.lit(groups))


def chain(c: Column, steps) -> Column:
    for step in steps:
        c = strip(c) if step == ENDS else replace(c, *step)
    return c


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, java("{s}+")), lambda x: x != "")


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(java("{S}+")))


def fewer_tokens(c: Column, n: Column) -> Column:
    """How many words c has, n if it has more; n is one or more. No more of it is split."""
    return let(strip(c), lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, java("{s}+"), n))))


def step(c: Column, needed: tuple[str, ...], pattern: str, to: str) -> Column:
    """replace() of texts that have all of needed, strings that every match has."""
    return let(c, lambda x: F.when(functools.reduce(lambda a, b: a & b, (F.contains(x, F.lit(n)) for n in needed)), replace(x, pattern, to)).otherwise(x))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def settled(value: Column) -> Column:
    """value, computed where it stands: the optimizer folds no projection into one that asks for its partition.

    Python functions need it whose argument is a deep nest of lambdas: folded into the call, the nest is not told apart.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def bound(function):
    """A function of a column that names it more than once, made to compute it once."""

    @functools.wraps(function)
    def run(c: Column, *args, **options) -> Column:
        return let(c, lambda x: function(x, *args, **options))

    return run


def bound2(function):
    """The same for a function of two columns."""

    @functools.wraps(function)
    def run(a: Column, b: Column, *args, **options) -> Column:
        return let(F.struct(a.alias("a"), b.alias("b")), lambda x: function(x["a"], x["b"], *args, **options))

    return run


@bound
def lines(c: Column) -> Column:
    """Split at every kind of line break; a break at the end opens no line. A text without one is not split."""
    last = F.when(c.endswith("\r\n"), 2).when(F.right(c, F.lit(1)).isin(list(BREAKS)), 1).otherwise(0)
    all_ = F.split(F.left(c, F.length(c) - last), rf"\r\n|{QUICK_BREAK}")
    return F.when(c == "", F.array().cast("array<string>")).when(functools.reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in BREAKS)), all_).otherwise(F.array(c))


SENTENCE_END = r"{s}(?<=[.!?]{s}){s}*(?=[A-Z])"


def sentences(c: Column) -> Column:
    """Pieces between a full stop, exclamation or question mark and a capital; stripped, none empty."""
    return F.filter(F.transform(F.split(c, java(SENTENCE_END)), strip), lambda x: x != "")


def first_sentences(c: Column, n: int) -> Column:
    """The first n of sentences(); no more of the text is split. None but the piece of a blank text is empty, as the first
    has a mark at its end and all others begin with a capital.
    """
    return F.slice(F.filter(F.transform(F.slice(F.split(c, java(SENTENCE_END), n + 1), 1, n), strip), lambda x: x != ""), 1, n)


#: A run of word characters that are not all plain letters.
MIXED = r"[\p{L}\p{N}_]*[\p{N}_\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2C00}-\x{10FFFF}][\p{L}\p{N}_]*"


#: The same runs, found without going back: the letters that are no part of that class, then one that is.
QUICK_MIXED = r"[A-Za-z[\x{2000}-\x{2BFF}&&\p{L}]]*+" + MIXED[MIXED.index("*") + 1 : -1] + "*+"


def plain_words(c: Column) -> Column:
    """Text in which words that are not all plain letters are a 0, so that word edges need no regard to script."""
    return replace(c, QUICK_MIXED, "0")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(java(pattern)))


def chars_of(c: Column, some: str) -> Column:
    """How many characters of c are among some."""
    return F.length(c) - F.length(F.regexp_replace(c, "[" + "".join(f"\\x{{{ord(x):X}}}" for x in some) + "]+", ""))


LETTERS = string.ascii_letters


def has(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def capped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))

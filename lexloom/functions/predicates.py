"""Validity predicates over text, lines and sentences, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import normalize as N
from lexloom.functions import text as T

# Words and marks of running headers, footers and legal lines.
BOILERPLATE_WORDS = r"\b(page|copyright|all rights reserved|draft|confidential|proprietary|published by|printed in|edition|isbn|reproduction|unauthorized|reserved)\b"
BOILERPLATE_MARKS = r"(www\.|http|https|\.com|\.org|\.edu|\.net|@)"
BOILERPLATE_YEAR = r"\b(19|20)[0-9]{2}\b"
BOILERPLATE_RIGHTS = r"(?i)©{s}*{d}{4}|\(c\){s}*{d}{4}"


@T.bound
def text_valid(c: Column, min_chars: int = 100) -> Column:
    """Long enough, words of 20 characters or fewer on average, and a twentieth of plain vowels."""
    n = T.count_tokens(c)
    chars = F.length(c) - T.chars_of(c, T.WS_CHARS)
    vowels = T.chars_of(c, "aeiouAEIOU")
    short_words = F.when(n == 0, True).otherwise(chars / n <= F.lit(20.0))
    return F.coalesce((F.length(c) >= min_chars) & short_words & (vowels / F.greatest(F.length(c), F.lit(1)) >= F.lit(0.05)), F.lit(False))


#: Letters and digits, [\\p{L}\\p{N}]+ as the JVM finds them soonest.
ALNUM = "[" + T.QUICK["w"].replace("_", "") + "]+"


def valid_chunk(c: Column) -> Column:
    def judged(t: Column) -> Column:
        alnum = F.length(t) - F.length(T.replace(t, ALNUM, ""))
        return F.coalesce((F.length(t) >= 50) & (T.fewer_tokens(t, F.lit(10)) >= 10) & (alnum / F.length(t) >= F.lit(0.3)), F.lit(False))

    return T.let(T.strip(c), judged)


def long_enough(c: Column, least: int = 100) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))


def summary_ok(c: Column, over: int = 20) -> Column:
    return F.coalesce(F.length(T.strip(c)) > over, F.lit(False))


#: Digits; up to five capitals; two to eight capitals, digits and hyphens with a digit; four or more without a plain vowel.
DATA_TOKEN = r"^(?:{d}+|[A-Z]{1,5}|(?=[A-Z0-9-]*[0-9])[A-Z0-9-]{2,8}|[^aeiouAEIOU]{4,})\z"


#: The same of words inside a line, each with white space before it.
DATA_WORD = r"{s}(?:{d}+|[A-Z]{1,5}|(?=[A-Z0-9-]*[0-9])[A-Z0-9-]{2,8}|[^aeiouAEIOU" + T.QUICK["s"] + r"]{4,})(?!{S})"


def data_row(line: Column) -> Column:
    """Four words or more, over half of them data."""
    fewer = lambda x, n: F.when(n == 0, False).otherwise(T.let(T.fewer_tokens(x, 2 * n), lambda m: (m >= 4) & (m < 2 * n)))
    return T.let(line, lambda x: T.let(T.count_of(F.concat(F.lit(" "), x), DATA_WORD), lambda n: fewer(x, n)))


@T.bound
def boilerplate(line: Column) -> Column:
    canon = N.canonical(line)

    def told(k: Column) -> Column:
        n = T.count_tokens(k)
        return (
            (F.length(k) < 4)
            | (n <= 2)
            | T.has(k, "^[0-9]+$")
            | T.has(k, BOILERPLATE_WORDS)
            | T.has(F.lower(line), BOILERPLATE_MARKS)
            | ((n <= 10) & T.has(k, BOILERPLATE_YEAR))
            | T.has(line, BOILERPLATE_RIGHTS)
        )

    return T.let(canon, told)


def symbol_line_ok(line: Column) -> Column:
    """Blank, or two fifths or more of plain letters and digits."""
    return T.let(T.strip(line), lambda s: (s == "") | (T.chars_of(s, T.LETTERS + "0123456789") / F.length(s) >= F.lit(0.4)))


def page_number(line: Column) -> Column:
    return T.has(T.strip(line), r"^{d}+(?:\.{d}+)?$")


def long_sentence(c: Column, least: int = 5) -> Column:
    return T.count_tokens(c) >= least

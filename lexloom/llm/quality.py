"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a column expression over the whole text, so the operator is a narrow
projection: no shuffle, no state and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import let, put, words_of

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?|()[]{}\"'"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the of and to a in is it that for on with as was be by this are or an at from not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


@dataclass(frozen=True)
class Rule:
    """low <= statistic <= high; a side that is None is open. An undefined statistic passes."""

    name: str
    statistic: str
    low: float | None = None
    high: float | None = None


#: The production table. Statistics are those of statistics().
RULES = (
    Rule("word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.05, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)


#: So many different windows that occur twice are looked up one by one; with more, all windows are sorted with their places.
FEW = 16


def _covered(hashes: Column) -> Column:
    """How many words the windows found twice or more cover, from the hash of the window at each word."""

    def by_sorting(hs: Column) -> Column:
        by_hash = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        return let(by_hash, positions)

    def by_looking(hs: Column, twice: Column) -> Column:
        return F.filter(F.transform(hs, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def union(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x,
        )

    repeated = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, j: F.get(s, j + 1) == x)))
    found = let(repeated, lambda r: let(F.when(F.size(r) <= FEW, by_looking(hashes, r)).otherwise(by_sorting(hashes)), union))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(found)


def _repeat_words(words: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(windows, _covered))


def statistics(text: Column) -> dict[str, Column]:
    """Base counts (long) and the ratios that the rules name; ratios of nothing are null."""
    whole = F.coalesce(text, F.lit(""))
    stop = sorted(set(" ".join(STOP_WORDS.values()).split()))
    apart = "[\\x20\\x09-\\x0D" + "".join("\\" + c for c in PUNCTUATION) + "]+"
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda xs, test: F.size(F.filter(xs, test)).cast("bigint")
    by_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("rep"), F.length(F.array_join(w, "")).cast("bigint").alias("chars")))
    by_lines = let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("bigint").alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dup"),
            count(ls, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("bullet"),
            count(ls, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("ellipsis"),
        ),
    )
    return {
        "by_words": by_words,
        "by_lines": by_lines,
        "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("bigint"),
        "n_stop": count(F.split(F.lower(whole), apart), lambda x: x.isin(stop)),
    }


def compiled(rules: tuple[Rule, ...], values: dict[str, Column]) -> Column:
    """The table as one boolean column."""
    verdict = F.lit(True)
    for rule in rules:
        value = values[rule.statistic]
        if rule.low is not None:
            verdict = verdict & F.coalesce(value >= F.lit(float(rule.low)), F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(value <= F.lit(float(rule.high)), F.lit(True))
    return verdict


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """A struct of RESULT for a text, from statistics that are computed once."""
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b)

    def judged(s: Column) -> Column:
        n, rep, lines = s["by_words"]["n"], s["by_words"]["rep"], s["by_lines"]["n"]
        values = {
            "mean_word_chars": ratio(s["by_words"]["chars"], n),
            "symbols_per_word": ratio(s["n_symbols"], n),
            "stop_word_ratio": ratio(s["n_stop"], n),
            "dup_line_ratio": ratio(s["by_lines"]["dup"], lines),
            "bullet_line_ratio": ratio(s["by_lines"]["bullet"], lines),
            "ellipsis_line_ratio": ratio(s["by_lines"]["ellipsis"], lines),
        }
        failed = (n < min_words) | (rep * 100 > n * max_repeat_percent)
        found = (n, s["by_words"]["chars"], s["n_symbols"], s["by_lines"]["dup"], rep, failed, ~failed & compiled(rules, values))
        return F.struct(*[c.alias(name) for c, name in zip(found, RESULT, strict=True)])

    return let(F.struct(*[v.alias(k) for k, v in statistics(text).items()]), judged)


def judge(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    A null or empty text has no words, so base_failed. A window of three words counts as found twice
    by its 64-bit hash. Very long texts are taken whole, repeated rows are judged alike, an empty table
    gives an empty result, and input columns named like the result's give way to them.
    """
    mid = put(docs, __verdict=verdict(F.col(f"`{text}`"), **options))
    return put(mid, **{name: F.col(f"__verdict.{name}") for name in RESULT}).drop("__verdict")


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs."""
    return docs.filter(verdict(F.col(f"`{text}`"), **options)["kept"])

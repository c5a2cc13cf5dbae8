"""Titles, authors, sections and chapters of a text, and the layout of finished summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T

# Section headers, heading and author patterns, and caps.
HEADERS = ["Abstract", "Introduction", "Related Work", "Background", "Methodology", "Method", "Approach", "Experiments", "Results", "Discussion", "Conclusion", "Conclusions", "References"]
HEADER = "(?im)^(" + "|".join(HEADERS) + ")[\\x09-\\x0D\\x1C-\\x20\\x{85}\\p{Z}]*$"
CHAPTER = r"(?im)^(?:Chapter|Ch\.){s}+({d}+)(?::|{s})+([^\n]+)"
PAPER_AUTHORS = [r"(?:Author|By):{s}*([A-Z][a-z]+ [A-Z][a-z]+)", r"([A-Z][a-z]+ [A-Z][a-z]+),{s}+{d}+"]
BOOK_AUTHORS = [r"(?:Author|By|Written by):{s}*([A-Z][a-z]+ [A-Z][a-z]+)", r"©{s}*{d}{4}{s}+([A-Z][a-z]+ [A-Z][a-z]+)"]
SECTION_CAP, CHAPTER_CAP, WHOLE_CAP, MAX_CHAPTERS = 4000, 4000, 8000, 5
NO_TITLE, NO_AUTHOR = "Unknown Title", "Unknown Author"


def _unix(pattern: str) -> str:
    """For "\\n" + text what pattern finds in text: no place but a newline is looked at. Only a newline ends a line for ^ and
    $. What both patterns match ends a line itself, so no match takes the newline that the next one needs.
    """
    return T.java(pattern).replace("(?im)^", r"(?imd)\n")


@T.bound
def sections(text: Column) -> Column:
    """array<struct<name, text>> by headers alone on their line; a repeated name keeps its first place and last text.

    Without a header the whole text is the section "body"; what precedes the first header is left out.
    """
    lead = F.concat(F.lit("\n"), text)
    names = F.regexp_extract_all(lead, F.lit(_unix(HEADER)), F.lit(1))

    def made(ns: Column) -> Column:
        cut = lambda bodies: F.transform(ns, lambda n, i: F.struct(F.initcap(F.lower(n)).alias("name"), F.left(T.strip(F.get(bodies, i + 1)), F.lit(SECTION_CAP)).alias("text")))
        pairs = F.filter(T.let(F.split(lead, _unix(HEADER)), cut), lambda p: p["text"] != "")
        unique = T.let(
            pairs,
            lambda ps: F.transform(
                F.array_distinct(F.transform(ps, lambda p: p["name"])),
                lambda n: F.struct(n.alias("name"), F.element_at(F.filter(ps, lambda p: p["name"] == n), -1)["text"].alias("text")),
            ),
        )
        return F.when(F.size(ns) == 0, F.array(F.struct(F.lit("body").alias("name"), text.alias("text")))).otherwise(unique)

    return T.let(names, made)


def summarised_sections(found: Column) -> Column:
    return F.filter(found, lambda s: F.lower(s["name"]) != "references")


@T.bound
def chapters(text: Column) -> Column:
    """array<struct<number, title, text>> by headings; without one the whole text is one chapter."""
    pattern, lead = _unix(CHAPTER), F.concat(F.lit("\n"), text)
    heads = F.regexp_extract_all(lead, F.lit(pattern), F.lit(0))

    def made(hs: Column) -> Column:
        found = T.let(
            F.split(lead, pattern),
            lambda bodies: F.transform(
                hs,
                lambda h, i: F.struct(
                    F.regexp_extract(h, pattern, 1).alias("number"),
                    F.left(T.strip(F.regexp_extract(h, pattern, 2)), F.lit(100)).alias("title"),
                    F.left(T.strip(F.get(bodies, i + 1)), F.lit(CHAPTER_CAP)).alias("text"),
                ),
            ),
        )
        whole = F.struct(F.lit("1").alias("number"), F.lit("Full Text").alias("title"), F.left(text, F.lit(WHOLE_CAP)).alias("text"))
        return F.when(F.size(hs) == 0, F.array(whole)).otherwise(found)

    return T.let(heads, made)


def top_chapters(found: Column, n: int = MAX_CHAPTERS) -> Column:
    """The first n, and of those the ones with text; later ones don't fill up."""
    return F.filter(F.slice(found, 1, n), lambda c: T.strip(c["text"]) != "")


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(F.transform(lines, T.strip), test), F.lit(0))


def _capital(x: Column) -> Column:
    return T.has(x, r"^\p{Lu}")


def paper_title(text: Column) -> Column:
    fits = lambda x: F.length(x).between(20, 200) & _capital(x)
    return F.coalesce(F.left(_first(F.slice(F.split(text, "\n", 11), 1, 10), fits), F.lit(150)), F.lit(NO_TITLE))


def book_title(text: Column) -> Column:
    def fits(x: Column) -> Column:
        n = F.length(x)
        capitals = T.has(x, r"\p{Lu}") & ~T.has(x, r"[\p{Ll}\p{Lt}]")
        return (capitals & (n > 10) & (n < 100)) | (_capital(x) & (n > 20) & (n < 150))

    return F.coalesce(_first(F.slice(F.split(text, "\n", 21), 1, 20), fits), F.lit(NO_TITLE))


@T.bound
def paper_authors(text: Column) -> Column:
    """Up to three distinct names, in the patterns' order."""
    return F.slice(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(T.java(p)), F.lit(1)) for p in PAPER_AUTHORS))), 1, 3)


@T.bound
def book_author(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, T.java(p), 1), F.lit("")) for p in BOOK_AUTHORS), F.lit(NO_AUTHOR))


def book_layout(title: Column, author: Column, total: Column, summarised: Column, overview: Column) -> Column:
    counts = F.concat(F.lit("**Chapters:** "), total.cast("string"), F.lit(" total, "), summarised.cast("string"), F.lit(" summarized"))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.when(author != NO_AUTHOR, F.concat(F.lit("**Author:** "), author)), counts, F.lit(""), F.coalesce(overview, F.lit("")))


def paper_layout(title: Column, authors: Column, found: Column, summary: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**Title:** "), title),
        F.when(F.size(authors) > 0, F.concat(F.lit("**Authors:** "), F.array_join(authors, ", "))),
        F.lit(""),
        F.when(F.size(found) > 0, F.concat(F.lit("*Sections covered: "), F.array_join(found, ", "), F.lit("*\n"))),
        F.coalesce(summary, F.lit("")),
    )

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.functions import metrics
from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.functions import text as T
from lexloom.operators import chunking, lines, structure


def on(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def one(spark, make, text):
    return on(spark, make, text)[0]


@pytest.mark.parametrize(
    "make, text, expected",
    [
        (N.missing_spaces, "3D v1.5,ok end.Next", "3 D v1. 5, ok end. Next"),
        (N.missing_spaces, "Made with Gamma", "Made with Gamma "),
        (N.newlines, "a\r\nb\rc\n", "a\nb\nc\n"),
        (N.strip_control, "a.\nB\tc", "a.Bc"),
        (N.dehyphenate, "inter-\n  national é-\né", "international éé"),
        (N.chunk_clean, unicodedata.normalize("NFKD", "résumé über!"), "re sume u ber"),
        (N.glyphs, "modern clear 1 vv", "modem dear I w"),
        (N.ligatures, "SPECI C of ce De nition speci cs", "specific office definition speci cs"),
        (N.canonical, "  The  É-Page 12! ", "the page 12"),
        (N.ocr_clean, "aé\n\n\n\nb  c.D ", "a \n\nb c. D"),
        (N.summary_clean, "### H\ntext.A\n\n\n\n\nb", "### H\n\ntext. A\n\nb"),
        (N.readability, "a.B c:d\n\n\n\ne ", "a. B c: d\n\ne"),
        (N.bullets, "• one\n- two!\n 3. three\n\n", "one. two! three."),
        (N.light_cleanup, "Good one. 123 456! 7a? ok", "Good one. 7a? ok"),
        (N.nfkd, "ﬁ é", "fi e\u0301"),
        (T.strip, "\u2003 a b\u00a0\n", "a b"),
    ],
)
def test_string_steps(spark, make, text, expected):
    assert one(spark, make, text) == expected


def test_stops_after_missing_spaces_change_nothing(spark):
    text = "3D v1.5,ok end.Next?Yes!No .5 a.B,c"
    assert one(spark, lambda c: N.after_stops(N.missing_spaces(c)), text) == one(spark, N.missing_spaces, text)


@pytest.mark.parametrize("text", ["", "a", "a\nb", "a\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029", "a\n\n", "\r\n\r\n"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, T.lines, text) == text.splitlines()


@pytest.mark.parametrize("text", ["", "  ", " a b\tc\n\u2003d\x1fe ", "é x"])
def test_tokens_are_those_of_split(spark, text):
    assert one(spark, T.tokens, text) == text.split()


def test_predicates(spark):
    assert on(spark, P.data_row, "12 AB X-9 foo", "12 AB X-9", "one two three four", "bcdf ghjk 12 a") == [True, False, False, True]
    assert on(spark, P.page_number, "12", " 3.5 ", "x", "", "1.2.3") == [True, True, False, False, False]
    assert on(spark, P.symbol_line_ok, "", "abc", "#$%a", "ab###") == [True, True, False, True]
    assert on(spark, P.text_valid, "word " * 30, "short", None, "x" * 200, "bcd " * 50) == [True, False, False, False, False]
    assert on(spark, P.valid_chunk, "word " * 12, "word " * 5, " ", None, "- - " * 40) == [True, False, False, False, False]
    assert on(spark, P.boilerplate, "", "Page 3 of the long book here", "see www.example.org for more of it", "in the year 1999 we met", "an ordinary line of text here", "© 2020 by the one and only us") == [True, True, True, True, False, True]
    assert on(spark, P.summary_ok, "x" * 21, "x" * 20, None) == [True, False, False]


def test_repeated_lines_at_the_defaults_remove_nothing(spark):
    text = "Page 1\nPage 2\nPage 3\nthe body of it"
    assert on(spark, lines.remove_repeated_lines, text, "\n \n", "") == [text, "", ""]
    assert one(spark, lambda c: lines.remove_repeated_lines(c, 0.2, 0.9), "Page 1\nthe body of it\nPage 1") == "the body of it"


def test_first_lines(spark):
    assert one(spark, lines.first_lines, "a\n\n a\nb\n\nb ") == "a\n\nb\n"
    assert one(spark, lambda c: lines.first_lines(c, lines.loose_key), "A b!\na, b\nab") == "A b!\nab"


def fold(text):
    """Paragraphs by the fold itself."""
    out, open_ = [], ""
    for line in (x.strip() for x in text.splitlines()):
        head = line.isupper() or bool(__import__("re").match(r"\d+(\.\d+)*\s+[A-Z]", line)) or (len(line.split()) <= 6 and line.endswith(":"))
        if not line:
            out, open_ = out + [open_] * bool(open_), ""
        elif open_ and open_[-1] not in ".!?:" and not head:
            open_ += " " + line
        else:
            out, open_ = out + [open_] * bool(open_), line
    return "\n\n".join(out + [open_] * bool(open_))


@pytest.mark.parametrize("text", ["", "a\nb\n\nc.\nd", "HEAD\nbody\n1.2 Title\nmore:\nx\n\n\ny", "\n\na\nNotes on it:\nb", "a b c d e f g:\nh", "x\n  \ny!"])
def test_paragraphs_equal_the_fold(spark, text):
    assert one(spark, lambda c: N.paragraphs(T.lines(c)), text) == fold(text)


def test_cleaner_flattens_lines_and_the_repair_keeps_them(spark):
    text = "First line of it.\nSecond line of it.\n42\nThird one"
    assert one(spark, lines.clean, text) == "First line of it.Second line of it.42Third one"
    assert one(spark, lambda c: lines.clean(c, keep_newlines=True), text) == "First line of it.\n\nSecond line of it.\n\nThird one"
    assert on(spark, lines.clean, "", None, "#$%^&*", "1 2 3 4 5 6") == ["", "", "", ""]


def test_sentences(spark):
    assert one(spark, T.sentences, "One. Two! three? Four 5. six") == ["One.", "Two! three?", "Four 5. six"]
    assert one(spark, chunking.split_sentences, "Dr. Who met i.e. Ann. See Fig. A. End") == ["Dr. Who met i.e. Ann.", "See Fig. A.", "End"]


def test_paragraph_split_modes(spark):
    assert one(spark, chunking.split_paragraphs, "a\n\nb\n \nc") == ["a", "b", "c"]
    assert one(spark, chunking.split_paragraphs, "x\n1.1 Ab\ny\n1.2 Cd") == ["x", "1.1 Ab\ny", "1.2 Cd"]
    assert one(spark, chunking.split_paragraphs, "One. Two.\n\nthree") == ["One.", "Two.\n\nthree"]


def test_syllables(spark):
    words = ["the", "table", "queue", "apple", "rhythm", "education", "well-known"]
    assert on(spark, metrics.syllables, *words) == [1, 1, 1, 1, 1, 4, 2]


def test_metrics(spark):
    long = "The happy cat sat on the warm mat. It was very glad to see the other animals there. "
    assert on(spark, metrics.flesch, "short", None, "12 34. " * 20) == [50.0, 50.0, 50.0]
    assert 60 < one(spark, metrics.flesch, long) <= 100
    assert one(spark, metrics.redundancy, long * 4) == pytest.approx(6 / 8)
    assert one(spark, metrics.redundancy, long) == 0
    assert one(spark, metrics.density, "alpha beta alpha of") == 1.0 and one(spark, metrics.density, "") == 0
    cover = lambda s: lambda c: metrics.coverage(c, F.lit(s))
    assert one(spark, cover("alpha other"), "alpha beta gamma delta") == pytest.approx(0.325)
    assert one(spark, cover("x"), "the of") == 0.5 and one(spark, cover("x"), "") == 0.0
    got = one(spark, lambda c: metrics.evaluate(c, F.lit(""), rounded=True), "text")
    assert got["overall_score"] == 0.0 and got["readability_flesch"] == 50.0 and got["length_penalty"] is None
    full = one(spark, lambda c: metrics.evaluate(c, F.lit("alpha beta"), rounded=True), "alpha beta gamma delta " * 5)
    assert (full["compression_ratio"], full["original_words"], full["summary_words"], full["compression_percent"]) == (10.0, 20, 2, "10.0%")


PAPER = "Title of a Good Paper Here\nAnn Lee, 1\nAbstract\nfirst\nIntroduction\n\n  second \nRESULTS  \nthird\nabstract\nagain\nReferences\n[1]"


def test_sections(spark):
    got = one(spark, structure.sections, PAPER)
    assert [(s["name"], s["text"]) for s in got] == [("Abstract", "again"), ("Introduction", "second"), ("Results", "third"), ("References", "[1]")]
    assert [s["name"] for s in one(spark, lambda c: structure.summarised_sections(structure.sections(c)), PAPER)] == ["Abstract", "Introduction", "Results"]
    assert [(s["name"], s["text"]) for s in one(spark, structure.sections, "no header")] == [("body", "no header")]
    assert len(one(spark, structure.sections, "Abstract\n" + "x" * 5000)[0]["text"]) == 4000


def test_titles_and_names(spark):
    assert on(spark, structure.paper_title, PAPER, "short\nlower case line that is long enough") == ["Title of a Good Paper Here", "Unknown Title"]
    assert on(spark, structure.book_title, "x\nA LONG TITLE", "A Title of More Than Twenty", "x") == ["A LONG TITLE", "A Title of More Than Twenty", "Unknown Title"]
    assert one(spark, structure.paper_authors, "By: Ann Lee\nBob Ray, 3\nAnn Lee, 4") == ["Ann Lee", "Bob Ray"]
    assert on(spark, structure.book_author, "Written by: Ann Lee", "© 2001 Bob Ray", "none") == ["Ann Lee", "Bob Ray", "Unknown Author"]


def test_chapters(spark):
    text = "intro\nChapter 1: One\nbody one\nch. 2 Two\n\nCHAPTER 3\nThree\nbody"
    got = one(spark, structure.chapters, text)
    assert [(c["number"], c["title"], c["text"]) for c in got] == [("1", "One", "body one"), ("2", "Two", ""), ("3", "Three", "body")]
    assert [c["number"] for c in one(spark, lambda c: structure.top_chapters(structure.chapters(c)), text)] == ["1", "3"]
    swallowed = one(spark, structure.chapters, "Chapter 1\nChapter 2 X\ny")
    assert [(c["number"], c["title"], c["text"]) for c in swallowed] == [("1", "Chapter 2 X", "y")]
    assert one(spark, structure.chapters, "none")[0]["title"] == "Full Text"


def test_layouts(spark):
    book = lambda c: structure.book_layout(c, F.lit("Unknown Author"), F.lit(3), F.lit(2), F.lit("over"))
    assert one(spark, book, "T") == "# T\n**Chapters:** 3 total, 2 summarized\n\nover"
    paper = lambda c: structure.paper_layout(c, F.array(F.lit("A B")), F.array(F.lit("X"), F.lit("Y")), F.lit("s"))
    assert one(spark, paper, "T") == "**Title:** T\n**Authors:** A B\n\n*Sections covered: X, Y*\n\ns"

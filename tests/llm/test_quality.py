import re
from collections import Counter

from lexloom.llm import quality, queries

SF = "/root/testdata/sf0.001"
STOP = set(" ".join(quality.STOP_WORDS.values()).split())


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    n = len(w)
    stop = sum(x in STOP for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"""[.,;:!?|()\[\]{}"']""", " ", text.lower())))
    good = not failed and 2.5 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.05 and dup / len(lines) <= 0.5
    good = good and sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines) / len(lines) <= 0.9
    good = good and sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines) / len(lines) <= 0.3
    return n, chars, symbols, dup, len(covered), failed, good


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_quality_rules(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {k: brute(t) for k, t in texts.items()}
    plan = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


ODD = [None, "", " \n\t", "a b a b a b", "a b c a b c", "x\x0by\x0cz\r", "é ü 𝄞 " * 40, "same line here\n" * 30, "- the cat sat on it\n" * 60, "# $ % & | < > *", "the " * 30000, "the cat of it...\n" * 30, "a  b\n\n c \n", " the cat " * 60]


def test_odd_rows(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, "x", 7), (1, ODD[1], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept int")
    got = quality.judge(docs)
    assert [c for c in got.columns if c.lower() == "kept"] == ["kept"]
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got.collect()), key=str) == sorted(((k, *brute(t)) for k, t, _ in rows), key=str)
    assert quality.judge(docs.limit(0)).collect() == [] and quality.keep_good(docs.limit(0)).collect() == []


def test_filter_keeps_columns_and_good_rows(spark):
    good = " ".join(f"the w{i} of" for i in range(40))
    docs = spark.createDataFrame([(1, good, 5, "s"), (2, "short", 6, None), (3, None, None, None)], "doc_id long, text string, n_words int, kept string")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, good, 5, "s")]
    assert quality.keep_good(docs.select("doc_id", "text")).columns == ["doc_id", "text"]

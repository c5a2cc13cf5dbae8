import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexloom.llm import fim, queries

SF = "/root/testdata/sf0.01"


def plain_version(doc_id, text):
    """The contract, with re and lists of words."""
    text = text or ""
    words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(words) + 1), h2 % (len(words) + 1)))
    x, y, z = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(words), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 80 else ("psm", f"<P>{x}<S>{z}<M>{y}")
    return doc_id, len(words), form, len(x), len(y), sha(out), sha(text)


def test_query_equals_the_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op11_fill_in_middle(spark, SF).collect()}
    assert got == {plain_version(*r) for r in rows} and {r[2] for r in got} == {"plain", "psm", "spm"}


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "a <P> b"), (6, "x < S> <\nM>"), (None, "no key here at all"), (7, "é 😀 \x0bß" * 9), (8, "w " * 300_000), (9, " " * 200_000), (9, "again"), (9, "again")]
ODD += [(100 + i, "ends with <S and begins <" * (i + 1)) for i in range(30)]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "old", 7) for r in ODD], "doc_id long, text string, output string, N long")
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    got = made.select("*", fim.restored(made["output"], made["form"])["text"].alias("back")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], hashlib.sha256(r["back"].encode()).hexdigest()) for r in got))) == sorted(map(repr, (plain_version(*r) for r in ODD)))
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert fim.transform(docs.limit(0)).collect() == []


pieces = st.lists(st.sampled_from(["<", "<S", "P>", "M", ">", " ", "\n", "word", "<<"]), max_size=12).map("".join)


@given(pieces, st.integers(0, 50))
def test_outputs_are_put_back(text, key):
    import regex

    plan = fim.Plan(rate=100, suffix_first=key % 2 * 100)
    n, form, _, _, output = fim.rearranged(text, key, plan, regex.compile(plan.unit))
    assert fim.put_back(output, form, plan) == text
    assert (form == "plain") == (not text or any(m in text for m in plan.marks))


def test_other_plans():
    import regex

    letters = fim.Plan(seed=1, rate=100, suffix_first=0, prefix="\x01", suffix="\x02", middle="\x03", unit=".")
    n, form, a, m, output = fim.rearranged("abcdef", 5, letters, regex.compile(letters.unit))
    assert (n, form) == (6, "psm") and output.startswith("\x01" + "abcdef"[:a]) and output.endswith("\x03" + "abcdef"[a : a + m])
    with pytest.raises(ValueError):
        fim.Plan(prefix="<P", suffix="S<")
    with pytest.raises(ValueError):
        fim.put_back("no mark", "psm", fim.Plan())

import hashlib
import random
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import ctph, queries

SF = "/root/testdata/sf0.001"


def slow_signature(data, size):
    out, begin, cuts = "", 0, 0
    for i in range(6, len(data)):
        h = 0
        for c in data[i - 6 : i + 1]:
            h = (h * 0x01000193 + c) % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2**32
        h ^= h >> 13
        if (h // 2 + 1) % size == 0 and cuts < 63:
            cuts += 1
            out += ctph.ALPHABET[zlib.crc32(data[begin : i + 1]) % 64]
            begin = i + 1
    return out + (ctph.ALPHABET[zlib.crc32(data[begin:]) % 64] if begin < len(data) else ""), cuts


def slow_fingerprint(text):
    """Byte by byte, one block size after the other."""
    data = text.encode()
    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and slow_signature(data, size)[1] < 31:
        size //= 2
    return f"{size}:{slow_signature(data, size)[0]}:{slow_signature(data, 2 * size)[0]}"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else 1 + min(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_alike(a, b):
    if a == b:
        return 1.0 if a else 0.0
    k = min(7, max(1, min(len(a), len(b)) // 4))
    if not any(a[i : i + k] == b[j : j + k] for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a and b):
        return 0.0
    return 1 - slow_distance(a, b) / (len(a) + len(b))


def slow_likeness(f, g):
    if f == g:
        return 1.0
    one, two = ({int(s) * m: sig for m, sig in ((1, x), (2, y))} for s, x, y in (f.split(":"), g.split(":")))
    return max((slow_alike(one[s], two[s]) for s in one.keys() & two.keys()), default=0.0)


def expected(rows):
    """Rows of (doc_id, text) in descending order, each with the next."""
    h = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1])))
    out = []
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        f, g, n = map(slow_fingerprint, (t, changed, after))
        out.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, g, round(slow_likeness(f, g), 9), round(slow_likeness(f, n), 9)))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((*r[:-2], round(r[-2], 9), round(r[-1], 9))) for r in map(tuple, df.collect()))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(k, t) for k, t in rows if len(t) < 6000] + [(k, t) for k, t in rows if len(t) >= 6000]
    assert found(queries.op12_document_fingerprints(spark, SF)) == expected(rows)


ODD = [(3, None), (2, ""), (2, "same key"), (2, "same key"), (None, "no key"), (None, "no key either"), (9, "a" * 5000), (8, "ab" * 3000), (7, "é😀" * 40), (-4, "x"), (11, " ".join(map(str, range(3000)))), (12, "12345678")]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_odd_rows(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(*r, "z") for r in ODD], "doc_id long, text string, K string").repartition(5)
        assert found(ctph.with_next(docs, ctph.edit_report, ctph.EDIT_FIELDS)) == expected(ODD)
        assert ctph.with_next(docs.limit(0), ctph.edit_report, ctph.EDIT_FIELDS).collect() == []
        one = docs.filter("doc_id = 11")
        assert found(ctph.with_next(one, ctph.edit_report, ctph.EDIT_FIELDS)) == expected(ODD[-2:-1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_columns(spark):
    df = spark.createDataFrame([("some text that is long enough to be cut somewhere",), (None,)], "t string")
    got = df.select(ctph.fingerprint(df["t"]).alias("f")).select("f", ctph.likeness("f", "f").alias("same")).collect()
    assert got[1]["f"] == "3::" and all(r["same"] == 1 for r in got)


@given(st.text("abc d\n", max_size=400), st.text("abc d\n", max_size=400))
@settings(max_examples=60, deadline=None)
def test_fingerprint_and_likeness_of_any_text(a, b):
    f, g = ctph.fingerprint_of(a), ctph.fingerprint_of(b)
    assert f == slow_fingerprint(a) and abs(ctph.likeness_of(f, g) - slow_likeness(f, g)) < 1e-12 and ctph.likeness_of(f, g) == ctph.likeness_of(g, f)


def test_long_texts_go_in_strides(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    whole = ctph.fingerprint_of(text)
    monkeypatch.setattr(ctph, "STRIDE", 1000)
    assert ctph.fingerprint_of(text) == whole == slow_fingerprint(text)


def test_a_few_changes_leave_fingerprints_alike_and_other_texts_not(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if len(r["text"]) > 600]
    rng = random.Random(2)
    near, far = [], []
    for i, t in enumerate(docs):
        at = rng.randrange(len(t))
        near.append(ctph.likeness_of(ctph.fingerprint_of(t), ctph.fingerprint_of(t[:at] + "other words here" + t[at + 20 :])))
        far.append(ctph.likeness_of(ctph.fingerprint_of(t), ctph.fingerprint_of(docs[i - 7])))
    assert min(near) > 0.4 and sum(near) / len(near) > 0.85 and sum(far) / len(far) < 0.1

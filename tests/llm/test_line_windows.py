import re

from lexloom.llm import line_windows, queries

SF = "/root/testdata/sf0.001"


def filled(lines):
    return [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]


def brute(rows):
    """(key, n_lines, n_removed, text) of rows with distinct keys."""
    seen, out = set(), []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        f = filled(lines)
        gone = set()
        for j in range(len(f) - 2):
            window = tuple(x for _, x in f[j : j + 3])
            if window in seen:
                gone.update(range(f[j][0], f[j + 2][0] + 1))
            seen.add(window)
        out.append((k, len(f), sum(i in gone for i, _ in f), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        got = queries.op9_line_dedup(spark, sf)
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


ODD = [
    (1, "a\nb\nc\nd"),
    (2, "x\n a \n\nb\t\nc\ny"),
    (3, "a\nb"),
    (4, "a\nb\nc"),
    (5, None),
    (6, ""),
    (7, "\n\n"),
    (8, "q\nq\nq\nq\nq"),
    (9, "b\nc\nd\nb\nc\nd\n"),
    (None, "z\na\nb\nc"),
    (-3, "b\nc\nd"),
    (10, "\n".join(f"line {i % 50}" for i in range(20000))),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in ODD], "doc_id long, text string, n_lines int")
    got = line_windows.dedup_lines(docs)
    assert sorted(got.columns) == ["doc_id", "n_lines", "n_removed", "text"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()), key=str) == brute(ODD)
    assert line_windows.dedup_lines(docs.limit(0)).collect() == []


def test_repeated_rows_get_the_same_text(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (2, "a\nb\nc\nd")]
    got = line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "a\nb\nc"), (2, "d"), (2, "d")]


def test_stage_drops_what_is_left_empty(spark):
    rows = [(1, "a\nb\nc", 5, "s"), (2, "a\nb\nc", 5, "s"), (3, "a\nb\nc\nd é", 9, None), (4, "", 0, None), (5, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __k string")
    got = line_windows.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a\nb\nc", 5, "s"), (3, "d é", 3, None), (4, "", 0, None), (5, None, None, None)], key=str)

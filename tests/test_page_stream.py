import pytest
from pyspark.sql import functions as F

from lexloom.plans import pipeline
from lexloom.sources import documents
from lexloom.streaming import events, pages

SCHEMA = "doc long, page int, pages int, text string"
LINE = "This is a sentence of the text that we have here, and it is long enough to be counted as one. "


def run(spark, tmp_path, rows, name, **options):
    """One more file of pages, then the stream from where it stood."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    query = pages.page_events(stream, events.parquet_sink(str(tmp_path / "out")), str(tmp_path / "ck"), **options)
    assert query.awaitTermination(240), name
    got = spark.read.parquet(str(tmp_path / "out"))
    out = {}
    for r in got.collect():
        out.setdefault(r["doc"], []).append(r)
    return {k: sorted(rs, key=lambda r: (r["type"] == "late_page", r["seq"])) for k, rs in out.items()}


def test_pages_of_a_table_give_its_events(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    rows = [tuple(r) for r in pages.split_into_pages(docs, lines=3).collect()]
    assert max(r[2] for r in rows) > 3
    run(spark, tmp_path, [r for r in rows if r[1] % 2 == 1], "odd pages")
    got = run(spark, tmp_path, [r for r in rows if r[1] % 2 == 0], "even pages, after a restart")
    joined = docs.select("doc_id", documents.join_pages(pages.page_array(F.col("text"), 3)).alias("text"))
    expected = {}
    for r in pipeline.run_pipeline(joined).drop("seconds").collect():
        expected.setdefault(r["doc_id"], []).append(r)
    names = [c for c in pipeline.run_pipeline(joined).columns if c not in ("doc_id", "seconds")]
    told = lambda r: tuple(repr(r[c]) for c in names)
    assert {k: [told(r) for r in rs] for k, rs in got.items()} == {k: sorted(map(told, rs), key=lambda t: int(t[0])) for k, rs in expected.items()}


def test_waiting_late_and_odd_pages(spark, tmp_path):
    first = [(1, 2, 3, LINE * 9), (1, 1, None, LINE * 8), (2, 1, 2, LINE * 7), (3, 1, 1, LINE * 6), (4, None, 0, None), (5, 1, None, LINE * 5), (None, 1, 1, LINE * 4), (6, 1, 2, LINE * 3), (6, 1, 2, "again"), (6, 7, 2, "beyond"), (6, None, 2, "no number")]
    got = run(spark, tmp_path, first, "first")
    assert set(got) == {3, 4, None} and got[4][0]["type"] == "error"
    got = run(spark, tmp_path, [(1, 3, None, None), (3, 1, 1, "late"), (6, 2, None, LINE)], "second")
    assert set(got) == {1, 3, 4, None, 6} and [r["type"] for r in got[3]].count("final") == 1
    assert got[3][-1]["type"] == "late_page" and got[3][-1]["message"] == "late"
    # the cleaner deletes the blank line between two pages, so two words become one
    assert got[1][0]["words"] == len((LINE * 17).split()) - 1 and got[6][0]["words"] == len((LINE * 4).split()) - 1
    got = run(spark, tmp_path, [(8, 1, 1, LINE * 2)], "third", wait_ms=0)
    got = run(spark, tmp_path, [(9, 1, 2, LINE * 2)], "fourth", wait_ms=0)
    assert 8 in got and 2 not in got  # timers that were set hold; only the new page waits for nothing
    got = run(spark, tmp_path, [(10, 1, 1, LINE * 2)], "fifth", wait_ms=0)
    assert got[9][0]["type"] == "doc_detected" and got[9][0]["words"] == len((LINE * 2).split())
    assert all([r["type"] for r in rs].count("final") <= 1 for rs in got.values())


def test_told_documents_are_forgotten(spark, tmp_path):
    run(spark, tmp_path, [(1, 1, 1, LINE * 3)], "first", remember_ms=0)
    run(spark, tmp_path, [(2, 1, 1, LINE * 3)], "the timer of the first runs out", remember_ms=0)
    got = run(spark, tmp_path, [(1, 1, 1, LINE * 3)], "a new document of that name", remember_ms=0)
    assert [r["type"] for r in got[1]].count("final") == 2


@pytest.mark.parametrize("lines", [1, 2, 50])
def test_page_array(spark, lines):
    texts = ["", "a", "a\nb\nc", "\n\n", "a\n" * 7]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pages.page_array(F.col("t"), lines)).collect()]
    for text, parts in zip(texts, got, strict=True):
        ls = text.split("\n")
        assert parts == ["\n".join(ls[i : i + lines]) for i in range(0, len(ls), lines)]

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.sources import paged


def fixed_pages(size, log):
    """A plug-in with pages of so many bytes each; it notes which ranges were opened."""

    class FixedPages:
        def count(self, file):
            return -(-file.size() // size)

        def read(self, file, begin, end):
            with open(log, "a") as f:
                f.write(f"{begin}-{end}\n")
            file.seek(begin * size)
            for _ in range(begin, end):
                yield [file.read(size).decode()]

    return FixedPages()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    text = "".join(f"page {i:04d}|" for i in range(1003))
    (tmp_path / "big.txt").write_text(text)
    made = paged.read_pages(spark, str(tmp_path / "big.txt"), fixed_pages(10, str(tmp_path / "log")), per_task=100)
    assert made.rdd.getNumPartitions() == 11
    got = made.orderBy("page").collect()
    assert [r["text"] for r in got] == [f"page {i:04d}|" for i in range(1003)] and [r["page"] for r in got] == list(range(1003))
    ranges = set((tmp_path / "log").read_text().split())
    assert ranges == {f"{b}-{min(b + 100, 1003)}" for b in range(0, 1003, 100)}


def test_parquet_rows_as_pages(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n, group in (("a", 25, 10), ("b", 7, 3), ("empty", 0, 3)):
        texts = [None if i == 4 else f"{name} {i} é" for i in range(n)]
        pq.write_table(pa.table({"text": pa.array(texts, pa.string()), "other": pa.array(range(n))}), folder / f"{name}.parquet", row_group_size=group)
    (folder / "_SUCCESS").write_text("")
    for per_task in (1, 4, 10, 1000):
        got = paged.read_pages(spark, f"file://{folder}", paged.ParquetPages(at_once=4), per_task).collect()
        assert sorted((r["path"][-9:], r["page"], r["text"] or "") for r in got) == sorted((f"{n}.parquet"[-9:], i, "" if i == 4 else f"{n} {i} é") for n, m in (("a", 25), ("b", 7)) for i in range(m)), per_task
    (tmp_path / "none").mkdir()
    assert paged.read_pages(spark, str(tmp_path / "none"), paged.ParquetPages()).collect() == []
    with pytest.raises(Exception, match="gone"):
        paged.read_pages(spark, str(tmp_path / "gone"), paged.ParquetPages()).collect()
    with pytest.raises(ValueError):
        paged.read_pages(spark, str(folder), paged.ParquetPages(), 0)


def test_pages_of_a_table_are_its_texts(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    made = paged.read_pages(spark, path, paged.ParquetPages(), per_task=30)
    want = spark.read.parquet(path).select(F.md5("text").alias("m"))
    assert made.rdd.getNumPartitions() == 7
    assert sorted(r["m"] for r in made.select(F.md5("text").alias("m")).collect()) == sorted(r["m"] for r in want.collect())

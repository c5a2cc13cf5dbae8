"""Files of many pages, read by many tasks: a data source that plans ranges of pages instead of files.

What a page is, a plug-in says: it counts the pages of an open file from what it can look up there, and reads a range of
them. Planning opens each file for its count alone; reading opens a file once for each range. Files are found and opened
through pyarrow's file systems, so a store must be one that pyarrow reaches; another one is refused with its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page bigint, text string"


class PagedFormat(Protocol):
    def count(self, file: BinaryIO) -> int:
        """How many pages an open file has."""

    def read(self, file: BinaryIO, begin: int, end: int) -> Iterator[list[str | None]]:
        """The texts of pages begin to end (from 0, end left out), some at a time."""


@dataclass(frozen=True)
class ParquetPages:
    """Rows of a Parquet file as pages: their number is in its footer, and row groups outside a range are not read."""

    column: str = "text"
    at_once: int = 256

    def count(self, file: BinaryIO) -> int:
        return pq.ParquetFile(file).metadata.num_rows

    def read(self, file: BinaryIO, begin: int, end: int) -> Iterator[list[str | None]]:
        parquet, at = pq.ParquetFile(file), 0
        for group in range(parquet.num_row_groups):
            rows = parquet.metadata.row_group(group).num_rows
            if at < end and at + rows > begin:
                row = at
                for batch in parquet.iter_batches(self.at_once, [group], [self.column]):
                    low, high = max(begin - row, 0), min(end - row, batch.num_rows)
                    if low < high:
                        yield batch.column(0).slice(low, high - low).to_pylist()
                    row += batch.num_rows
            at += rows


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class PageReader(DataSourceReader):
    def __init__(self, path: str, form: PagedFormat, per_task: int) -> None:
        self.path, self.form, self.per_task = path, form, per_task

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inside = store.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        out = []
        for found in sorted((f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            with store.open_input_file(found.path) as file:
                pages = self.form.count(file)
            out += [Range(found.path, b, min(b + self.per_task, pages)) for b in range(0, pages, self.per_task)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            page = partition.begin
            for texts in self.form.read(file, partition.begin, partition.end):
                numbers = range(page, page + len(texts))
                page += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(texts), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["path", "page", "text"])


def read_pages(spark: SparkSession, path: str, form: PagedFormat, per_task: int = 2000) -> DataFrame:
    """(path, page, text) of a paged file, or of all in a folder, in ranges of so many pages; page counts from 0.

    A file without pages and an empty folder give no row; a path that isn't there raises. Null pages are null texts.
    """
    if per_task < 1:
        raise ValueError("one page a task at least")
    place = path if "://" in path else f"file:///{path.lstrip('/')}" if not path.startswith("file:") else "file:///" + path.removeprefix("file:").lstrip("/")
    kind = f"pages_of_{type(form).__name__.lower()}"

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            return PageReader(place, form, per_task)

    spark.dataSource.register(Pages)
    return spark.read.format(kind).load()

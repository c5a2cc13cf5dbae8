"""Documents that arrive page by page: pages are held in keyed state until a document is whole, and then it is told once.

A page is a row (doc, page, pages, text): its number from 1 and how many the document has, null while that isn't known.
Pages come in any order and batch, some twice. A document is whole when its number of pages is known and all are there.
If none comes for a while, it is told as it is. A page that comes after its document was told is told by itself. After a
longer while a document is forgotten, so state holds what is open or recent, and not all that ever came.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexloom.functions import text as T
from lexloom.operators import models
from lexloom.plans import pipeline
from lexloom.sources import documents

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WHOLE, PARTIAL, LATE = "whole", "partial", "late"


class Assembler(StatefulProcessor):
    """Emits (doc, texts, missing, status): a document's pages in order once it is whole or has waited too long, and late pages."""

    def __init__(self, wait_ms: int, remember_ms: int) -> None:
        self.wait_ms, self.remember_ms = wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", StructType([StructField("pages", IntegerType()), StructField("told", IntegerType())]))
        self.held = handle.getMapState("held", StructType([StructField("page", IntegerType())]), StructType([StructField("text", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.head.get() if self.head.exists() else None
        fresh: dict[int, str] = {}
        total = known[0] if known and not known[1] and known[0] >= 0 else None
        for row in rows:
            if known and known[1]:
                yield self._row(key, [row.text], 0, LATE)
                continue
            total = total if row.pages is None else row.pages
            if row.page is not None:
                fresh.setdefault(row.page, row.text or "")
        if known and known[1]:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        held = {k[0]: v[0] for k, v in self.held.iterator()} if known else {}
        together = fresh | held
        if total is not None and all(p in together for p in range(1, total + 1)):
            yield self._told(key, together, total, now, known is not None)
            return
        for page, text in fresh.items():
            if page not in held:
                self.held.updateValue((page,), (text,))
        self.head.update((-1 if total is None else total, 0))
        self._wake(now + self.wait_ms, known is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.head.get() if self.head.exists() else None
        if known is None or known[1]:
            self.head.clear()
            return
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        total = known[0] if known[0] >= 0 else max(held, default=0)
        yield self._told(key, held, total, timerValues.getCurrentProcessingTimeInMs(), True)

    def _told(self, key, pages: dict[int, str], total: int, now: int, held: bool) -> Row:
        there = [pages[p] for p in sorted(pages) if p <= total]
        missing = sum(p not in pages for p in range(1, total + 1))
        if held:
            self.held.clear()
        self.head.update((total, 1))
        self._wake(now + self.remember_ms, held)
        return self._row(key, there, missing, PARTIAL if missing else WHOLE)

    def _wake(self, at: int, held: bool) -> None:
        """The one timer of a key; held: whether it may have one already."""
        for timer in list(self.handle.listTimers()) if held else ():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _row(self, key, texts: list[str], missing: int, status: str) -> Row:
        return Row(doc=key[0], texts=texts, missing=missing, status=status)

    def close(self) -> None:
        pass


def assembled(pages: DataFrame, wait_ms: int = 600_000, remember_ms: int = 86_400_000) -> DataFrame:
    """(doc, texts, missing, status) of a stream of pages (doc, page, pages, text); it needs the state provider of rocks().

    Of pages with the same number the first one counts. A null text is an empty page; a page without a number only tells
    how many there are; pages beyond that number are left out. A document of no page is whole at once.
    """
    kind = pages.schema["doc"].dataType
    out = StructType([StructField("doc", kind), StructField("texts", ArrayType(StringType())), StructField("missing", IntegerType()), StructField("status", StringType())])
    rows = pages.select("doc", F.col("page").cast("int"), F.col("pages").cast("int"), F.col("text").cast("string"))
    return rows.groupBy("doc").transformWithState(Assembler(wait_ms, remember_ms), out, "Append", "ProcessingTime")


@contextlib.contextmanager
def rocks(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which several states and timers for one key need.

    empty_batches: whether batches without input are run so that timers run out on time. A stream that ends with its input
    must not have them, as it would never end; its timers run out in the next batch that has input.
    """
    want = {PROVIDER: ROCKS, EMPTY: str(empty_batches).lower()}
    before = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def start(pages: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, wait_ms: int, remember_ms: int, options: dict) -> StreamingQuery:
    """The stream of assembled(): each(batch, number) gets its batches. Ends with the input unless options name another trigger."""
    when = options or {"availableNow": True}
    with rocks(pages.sparkSession, empty_batches=not (when.get("availableNow") or when.get("once"))):
        writer = assembled(pages, wait_ms, remember_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return writer.trigger(**when).start()


def page_documents(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, wait_ms: int = 600_000, remember_ms: int = 86_400_000, **options) -> StreamingQuery:
    """(doc, text, n_pages, missing, status) of each document once, and of each late page, to sink(rows, batch number),
    which must be idempotent by batch number.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(batch.select("doc", documents.join_pages(F.col("texts")).alias("text"), F.size("texts").alias("n_pages"), "missing", "status"), number)

    return start(pages, each, checkpoint, wait_ms, remember_ms, options)


def page_events(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, backend: models.Backend | None = None, wait_ms: int = 600_000, remember_ms: int = 86_400_000, **options) -> StreamingQuery:
    """Pipeline events of documents that arrive as pages, to sink(events, batch number), which must be idempotent by batch.

    A document's events are those of run_pipeline() over its pages joined by blank lines, and come once. A page that comes
    too late gives one event of type late_page.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        whole = batch.filter(F.col("status") != LATE).select("doc", documents.join_pages(F.col("texts")).alias("text"))
        events = pipeline.run_pipeline(whole, doc="doc", backend=backend)
        late = batch.filter(F.col("status") == LATE).select("doc", F.lit(0).alias("seq"), F.lit("late_page").alias("type"), F.element_at("texts", 1).alias("message"))
        sink(events.unionByName(late, allowMissingColumns=True), number)
        batch.unpersist()

    return start(pages, each, checkpoint, wait_ms, remember_ms, options)


def page_array(text: Column, lines: int = 20) -> Column:
    """A text as pages of so many lines each."""
    return T.let(F.split(text, "\n"), lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / lines).cast("int")), lambda i: F.array_join(F.slice(ls, i * lines + 1, lines), "\n")))


def split_into_pages(docs: DataFrame, doc: str = "doc_id", text: str = "text", lines: int = 20) -> DataFrame:
    """(doc, page, pages, text) of documents."""
    cut = docs.select(F.col(doc).alias("doc"), page_array(F.coalesce(F.col(text), F.lit("")), lines).alias("ps"))
    rows = cut.select("doc", F.size("ps").alias("pages"), F.posexplode("ps").alias("at", "text"))
    return rows.select("doc", (F.col("at") + 1).alias("page"), "pages", "text")

"""How many requests run at once, how fast a whole job may ask, and answers that outlive what asked for them."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexloom.operators.models import Backend, Request, Response
from lexloom.session import shuffles_end

A, B = TypeVar("A"), TypeVar("B")


def in_order(call: Callable[[A], B], items: Iterable[A], workers: int = 1) -> Iterator[B]:
    """call(item) of all items, in their order, with so many calls open at once.

    An item is drawn when a place gets free, so a long input is not read ahead. A call that raises ends the walk; what is
    open then is waited for. One worker makes no thread.
    """
    if workers < 1:
        raise ValueError("one worker at least")
    if workers == 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(workers) as pool:
        open_: deque = deque()
        try:
            for item in items:
                if len(open_) == workers:
                    yield open_.popleft().result()
                open_.append(pool.submit(call, item))
            while open_:
                yield open_.popleft().result()
        finally:
            for waiting in open_:
                waiting.cancel()


@dataclass
class SharedRate:
    """A backend under one limit for a whole job, without anything that tasks would have to ask for leave.

    Time is cut into slots of 1 / rate seconds, counted from the epoch. Of each `shares` slots in a row a task owns the one
    with its partition's number, and makes one call at most in a slot of its own. So all tasks of a stage of `shares`
    partitions together never make more calls than slots, however many of them run at once or start together, on machines
    whose clocks agree to a part of a slot. A task that is run again has the slots that the lost one had.
    """

    inner: Backend
    rate: float
    shares: int
    share: int | None = None
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _slot: int = field(default=-1, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        if self.rate <= 0 or self.shares < 1:
            raise ValueError("a rate over 0 and one share at least")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lock": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"_lock": threading.Lock()}

    @property
    def pause(self) -> float:
        return getattr(self.inner, "pause", 0.0)

    def _own(self) -> int:
        if self.share is None:
            context = TaskContext.get()
            self.share = context.partitionId() if context else 0
        if not 0 <= self.share < self.shares:
            raise ValueError(f"partition {self.share} of a stage that should have {self.shares}")
        return self.share

    def wait(self) -> int:
        """Waits for the next slot of its own that is not used yet; its number."""
        with self._lock:
            own, now = self._own(), self.clock() * self.rate
            at_least = max(int(now) + 1, self._slot + 1)  # a slot that has begun may be all but over
            slot = at_least + (own - at_least) % self.shares
            while (left := slot / self.rate - self.clock()) > 0:
                self.sleep(left)
            self._slot = slot
            return slot

    def complete(self, request: Request) -> Response:
        self.wait()
        return self.inner.complete(request)


ANSWERS = "key string, text string"


@dataclass(frozen=True)
class Answers:
    """A table of answers by request, in a folder of any store that Spark reaches.

    Requests are asked in blocks, by their keys. What a block is told is written before the next is asked, and what is
    written is never asked again: not by a stage that is run again, not by another job. Failures are not kept, so that they
    are asked anew. What a job that dies loses is the block it was at; more blocks lose less and start more jobs.
    """

    spark: SparkSession
    path: str
    model: str = ""

    def table(self) -> DataFrame:
        """(key, text), each key once."""
        try:
            return self.spark.read.schema(ANSWERS).parquet(self.path).groupBy("key").agg(F.min("text").alias("text"))
        except AnalysisException:
            return self.spark.createDataFrame([], ANSWERS)

    def keyed(self, requests: DataFrame) -> DataFrame:
        """requests with key; rows (prompt, max_tokens, temperature) that are alike have the same one."""
        parts = F.to_json(F.struct(F.lit(self.model).alias("m"), F.col("prompt").alias("p"), F.col("max_tokens").cast("int").alias("n"), F.col("temperature").cast("double").alias("t")))
        return requests.withColumn("key", F.sha2(parts, 256))

    def ask(self, requests: DataFrame, backend: Backend, blocks: int = 16, partitions: int | None = None, workers: int = 1) -> DataFrame:
        """requests (prompt, max_tokens, temperature and any others) with answer, null where the backend failed or the prompt is null.

        partitions: of each block's stage, as many as the shares of a SharedRate; workers: open requests in each.
        """
        named = self.keyed(requests)
        distinct = named.filter("prompt is not null").select("key", "prompt", F.col("max_tokens").cast("int"), F.col("temperature").cast("double")).dropDuplicates(["key"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def one(row: tuple) -> tuple[str, Response]:
                return row[0], backend.complete(Request(*row[1:]))

            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            told: list[tuple[str, str]] = []
            for key, answer in in_order(one, rows, workers):
                if answer.ok:
                    told.append((key, answer.text))
                if len(told) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*told, strict=True)], names=["key", "text"])
                    told = []
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*told, strict=True)], names=["key", "text"])

        for block in range(blocks):
            mine = distinct.filter(F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), F.lit(blocks)) == block)
            todo = mine.join(self.table(), "key", "left_anti")
            todo = todo.repartition(partitions) if partitions else todo
            with shuffles_end(self.spark):
                todo.mapInArrow(run, ANSWERS).write.mode("append").parquet(self.path)
        return named.join(self.table().withColumnRenamed("text", "answer"), "key", "left").drop("key")

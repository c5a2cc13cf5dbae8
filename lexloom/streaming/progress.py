"""Progress of a stream: what has been read and written, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Step:
    batch: int
    rows: int
    seconds: float


@dataclass
class Progress:
    """Collects a step for each batch that read rows, and tells when a query ends or fails."""

    steps: list[Step] = field(default_factory=list)
    ended: list[str | None] = field(default_factory=list)

    def listener(self) -> StreamingQueryListener:
        progress = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                p = event.progress
                if p.numInputRows:
                    progress.steps.append(Step(p.batchId, p.numInputRows, p.batchDuration / 1000))

            def onQueryTerminated(self, event) -> None:
                progress.ended.append(event.exception)

        return Listener()

    def watch(self, spark: SparkSession) -> Callable[[], None]:
        """Starts listening; what it returns ends that."""
        listener = self.listener()
        spark.streams.addListener(listener)
        return lambda: spark.streams.removeListener(listener)


def event_totals(events: DataFrame) -> DataFrame:
    """(type, n) of pipeline events."""
    return events.groupBy("type").agg(F.count("*").alias("n"))

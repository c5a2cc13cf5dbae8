"""The pipeline over a stream of documents: each micro-batch runs the same plan as a table would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexloom.operators import models
from lexloom.plans import pipeline


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_events(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, backend: models.Backend | None = None, quality: str = "Balanced", chunk_overlap: int = 2, **options) -> StreamingQuery:
    """Events of each micro-batch go to sink(events, batch number), which must be idempotent by batch number.

    Documents are independent of each other, so there is no state and no watermark.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(pipeline.run_pipeline(batch, backend=backend, quality=quality, chunk_overlap=chunk_overlap), number)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own, so a batch that is run again replaces itself."""
    return lambda events, number: events.write.mode("overwrite").parquet(f"{path}/batch={number}")

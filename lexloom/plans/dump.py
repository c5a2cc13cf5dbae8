"""Writes what each stage of the pipeline makes, for a look at what happens to a corpus on its way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.functions import text as T
from lexloom.operators import chunking, models
from lexloom.plans import pipeline
from lexloom.session import Scratch
from lexloom.sources.documents import write_stage

STAGES = ("01_raw", "02_cleaned", "03_chunks", "04_chunk_summaries", "05_final")


def dump_stages(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", backend: models.Backend | None = None) -> None:
    """A folder for each stage below path. Each stage is written once, and the next reads it from there."""
    spark = docs.sparkSession
    write_stage(docs.select(doc, F.col(text).alias("text")), f"{path}/{STAGES[0]}")
    ready = pipeline.gated(spark.read.parquet(f"{path}/{STAGES[0]}")).filter("passes").select(doc, "clean")
    write_stage(ready, f"{path}/{STAGES[1]}")
    found = chunking.chunk_or_head(F.col("clean"))
    chunked = spark.read.parquet(f"{path}/{STAGES[1]}").select(doc, T.settled(F.filter(found, lambda c: P.valid_chunk(c["text"]))).alias("chunks"))
    write_stage(chunked.select(doc, F.inline("chunks")), f"{path}/{STAGES[2]}")
    said = Scratch(spark).keep(chunked.select(doc, pipeline.condensed(F.transform("chunks", lambda c: c["text"]), backend).alias("said")))
    write_stage(said.select(doc, "said.summaries"), f"{path}/{STAGES[3]}", "json")
    write_stage(said.select(doc, N.readability(F.col("said.merged")).alias("text")), f"{path}/{STAGES[4]}")

"""Text sources and the sinks of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file, whole, with all newlines as \\n."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def gate(text: Column, least: int = 50) -> Column:
    """The text, or nothing if it has fewer characters than that once stripped."""
    return F.when(F.length(T.strip(text)) < least, "").otherwise(text)


def join_pages(pages: Column) -> Column:
    """Pages of a document, stripped, the empty ones left out, with a blank line between."""
    return F.array_join(F.filter(F.transform(pages, T.strip), lambda p: p != ""), "\n\n")


def page_text(native: Column, recognised: Column) -> Column:
    """A page's own text, or the recognised one where that is no valid text."""
    from lexloom.functions.predicates import text_valid

    return F.when(text_valid(native, 50), T.strip(native)).otherwise(T.strip(F.coalesce(recognised, F.lit(""))))


def write_stage(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A stage's rows as parquet, json, or text (the column text)."""
    writer = (df.select("text") if kind == "text" else df).write.mode("overwrite")
    getattr(writer, kind)(path)

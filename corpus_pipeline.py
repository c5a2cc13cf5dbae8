"""The corpus pipeline: documents pass five stages, each written as Parquet and read again.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents:
quality rules drop documents, line dedup drops lines that occurred before, near-dedup keeps one
document of a group, decontamination cuts benchmark passages out, and SentencePiece gives each text's
sampled segmentations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import fm_index, line_windows, quality, simhash, spm_sample
from lexloom.llm.common import remove, remove_at_end, shared_dir, shuffles_end


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_windows.drop_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_index.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a document and sample: doc_id, sample, n_pieces, scores, digest, round_trip and ids."""
    import public_tokenizers

    return spm_sample.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Sampling segmentations is nothing that SQL can say; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Stages but the last leave Parquet below the shared folder, each until the next is
    written, the last until the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_end(spark, top)
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{top}/{i}-{name}"
            with shuffles_end(spark):
                docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs

import os

import pytest
from pyspark.sql import functions as F

from lexloom.functions import tokens
from lexloom.plans import dump

GOOD = " ".join(f"This is sentence number {w} of the text that we have here." for w in "one two three four five six seven".split())


def test_every_stage_is_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, GOOD), (2, "short")], "doc_id long, text string")
    dump.dump_stages(docs, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(dump.STAGES)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert len(read("01_raw")) == 2 and [r["doc_id"] for r in read("02_cleaned")] == [1]
    assert [r["token_count"] for r in read("03_chunks")] == [len(GOOD.split())]
    said = spark.read.json(f"{tmp_path}/04_chunk_summaries").collect()
    assert said[0]["summaries"][0].startswith("- This is sentence number one") and "number two" in read("05_final")[0]["text"]


def test_tokens_of_a_vocabulary(spark, tmp_path):
    pytest.importorskip("tiktoken")
    import base64

    pairs = [bytes([b]) for b in range(256)] + [b"th", b"the", b" t", b" the"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(pairs)))
    count = tokens.bpe_counter(spark, str(tmp_path / "ranks"))
    rows = spark.createDataFrame([("the thee",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in rows.select(count(F.col("t"))).collect()] == [3, 0, 0, 2]

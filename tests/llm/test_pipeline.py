"""The pipeline against plain Python versions of its stages, each over what the one before kept."""

import hashlib
import re

import numpy as np
import public_tokenizers
from test_fm_index import brute as contaminated
from test_line_windows import brute as lines
from test_quality import brute as judged
from test_simhash import brute_components

import corpus_pipeline
from lexloom.llm import queries, spm_sample

SF = "/root/testdata/sf0.001"


def near(rows):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        if w:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    low = brute_components(list(sets.items()), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    return [(k, t) for k, t in rows if low.get(k, k) == k]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = {(r["doc_id"], r["text"]) for r in docs.collect()}
        if name == "quality_rules":
            rows = [(k, t) for k, t in rows if judged(t)[-1]]
        elif name == "line_dedup":
            rows = [(k, t) for k, n, gone, t in lines(rows) if gone < n or not n]
        elif name == "simhash_dedup":
            rows = near(rows)
        else:
            dirty = {r[0] for r in contaminated(rows, items) if r[5]}
            assert dirty and {r for r in rows if r[0] not in dirty} <= got and {k for k, _ in got} <= {k for k, _ in rows}
            assert not any(r[5] for r in contaminated(sorted(got), items))
            rows = sorted(got)
        assert got == set(rows), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    vocabulary = spm_sample.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    bank = spm_sample.Bank(vocabulary)
    expected = set()
    for k, t in rows:
        one = spm_sample.sample([t], np.array([spm_sample.row_seed(k, 0)], np.uint64), bank, 2)
        expected |= {(k, s + 1, hashlib.sha256(spm_sample.ids_of(e, bank).astype("<i4").tobytes()).hexdigest()) for s, e in enumerate(one.edges[0])}
    assert {(r["doc_id"], r["sample"], r["ids_sha256"]) for r in last} == expected and all(r["round_trip"] for r in last)


def test_query_runs_all_stages(spark):
    got = queries.pipeline(spark, SF).collect()
    assert got and all(r["round_trip"] for r in got) and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontaminate", "sentencepiece"]

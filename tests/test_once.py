"""What is dear is computed once, and batches are taken in runs."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.plans import catalog, pipeline


def plan(spark, name):
    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_layouts_make_each_text_once(spark):
    found = plan(spark, "format_summaries")
    assert found.count("repeat(") == 1 and found.count("A Study of Made Up Words") == 1


def test_scores_count_words_once(spark):
    assert plan(spark, "evaluate_summaries").count(T.rx("{S}+")) <= 4  # of both texts, and in two scores of the summary alone


ODD = ["", " ", "A. B. C. D. E.", " Is it? Yes! No.  So. x. Y", "one", "\n a.  B\x85C! D", "ab1 _x é ℂab Ω xℂé ﬁ a-b K 𝔸b", None]


def test_first_sentences_and_plain_words(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "t string")
    for n in (1, 2, 3):
        got = rows.select(T.first_sentences(F.col("t"), n).alias("a"), F.slice(T.sentences(F.col("t")), 1, n).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)
    got = rows.select(T.plain_words(F.col("t")).alias("a"), T.replace(F.col("t"), T.MIXED, "0").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


@pytest.mark.parametrize("rows", [[], [None], [["a"], None, [], ["bb", None, "c"], ["x" * 50], ["d"], ["e"], ["f"], ["g"]]])
def test_runs(rows):
    given = pa.array([["cut off"], *rows], pa.list_(pa.string())).slice(1)
    found = list(pipeline.runs(given, 3, 10))
    assert [r for run in found for r in run] == rows
    for run in found:
        assert len(run) <= 3 and (len(run) == 1 or sum(len(x or "") for r in run for x in r or []) <= 10)

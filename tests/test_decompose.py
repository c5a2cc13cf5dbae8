import random
import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import decompose

MARKS = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]


def decomposed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    made = df.select("i", decompose.nfkd(F.col("t")).alias("d"))
    return [r["d"] for r in made.orderBy("i").collect()], made


def test_every_code_point(spark):
    codes = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["|".join(codes[i : i + 500]) for i in range(0, len(codes), 500)]
    got, _ = decomposed(spark, texts)
    assert got == [unicodedata.normalize("NFKD", t) for t in texts]


def test_marks_come_in_canonical_order(spark):
    rng = random.Random(1)
    letters = ["a", "é", "ﬁ", "각", "가", "𝔄", "ǖ", "😀", " ", "한글"]
    texts = ["".join(rng.choice(letters) + "".join(rng.choices(MARKS, k=rng.randrange(5))) for _ in range(30)) for _ in range(200)]
    texts += [None, "", "plain ascii\x00\n", "".join(MARKS[:300]), "q̣̇", "̣̈́", "é" * 20_000]
    got, made = decomposed(spark, texts)
    assert got == [t if t is None else unicodedata.normalize("NFKD", t) for t in texts]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_any_text(spark, texts):
    assert decomposed(spark, texts)[0] == [unicodedata.normalize("NFKD", t) for t in texts]

import pytest
from pyspark.sql import functions as F

from lexloom.functions import detect
from lexloom.plans.pipeline import adaptive_route

CHAPTERS = "\n".join(f"Chapter {i}: Heading {i}\nSome words of the body." for i in range(1, 6)) + "\n"
SECTIONS = "Abstract\nwords\nIntroduction\nwords\nMethodology\nwords\nResults\nwords\nDiscussion\nwords\nConclusion\nwords\nReferences\n[1] x\n"
indent = lambda s: "".join("    " + line + "\n" for line in s.splitlines())


def found(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(detect.detection(F.col("t")).alias("d")).withColumn("route", adaptive_route(F.col("d"))).first()
    return row["d"], row["route"]


@pytest.mark.parametrize(
    "text, kind, confidence, route",
    [
        ("\n" + indent(CHAPTERS) * 10, "general", 1.0, "general"),
        ("\n" + indent(SECTIONS), "general", 0.75, "general"),
        ("    We sold more.\n    Costs fell.\n", "general", 1.0, "general"),
        (CHAPTERS, "book", 0.6, "general"),
        (CHAPTERS * 10, "general", 0.6, "general"),
        (SECTIONS, "paper", 0.69, "paper"),
        ("", "general", 1.0, "general"),
    ],
)
def test_samples(spark, text, kind, confidence, route):
    got, way = found(spark, text)
    assert (got["type"], got["confidence"], way) == (kind, confidence, route)


def test_metadata_and_flags(spark):
    got, _ = found(spark, SECTIONS)
    assert got["metadata"]["has_abstract"] is False and got["metadata"]["has_chapters"] is None and got["metadata"]["words"] == 15
    long = CHAPTERS + "TABLE OF CONTENTS\n" + "word " * 30000
    got, way = found(spark, long)
    assert (got["type"], got["metadata"]["has_chapters"], way) == ("book", True, "book")


def test_flattened_text_is_never_a_paper(spark):
    got, _ = found(spark, SECTIONS.replace("\n", " "))
    assert got["type"] == "general"


def test_long_abstract_needs_a_hundred_characters_without_letters(spark):
    score = lambda t: spark.createDataFrame([(t,)], "t string").select(detect.paper_score(F.col("t"))).first()[0]
    assert score("Abstract\nA" + " long text of it" * 20) == pytest.approx(0.0625 + 0.1)
    assert score("Abstract\nA" + "1" * 100) == pytest.approx(0.0625 + 0.25)

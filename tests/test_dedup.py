import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import dedup

SCHEMA = "g string, k long, v array<float>"


def loop(rows, threshold):
    """(g, k, hash, v) one after the other."""
    kept = {}
    for g, k, _, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        v = [x or 0.0 for x in v or []]
        n = math.sqrt(sum(x * x for x in v))
        near = any(n and m and sum(x * y for x, y in zip(v, w, strict=False)) / (n * m) > threshold for _, w, m in kept.get(g, []))
        if not near:
            kept.setdefault(g, []).append((k, v, n))
    return sorted((str(g), str(k)) for g, rs in kept.items() for k, _, _ in rs)


def spark_rows(df):
    return [(r["g"], r["k"], r["h"], r["v"]) for r in df.withColumn("h", F.xxhash64(F.col("v").cast("array<double>"))).collect()]


@pytest.mark.parametrize(("threshold", "batch", "part"), [(0.3, 7, 5), (0.6, 40, 30), (0.0, 3, 1000), (0.3, 1000, 8000)])
def test_rounds_equal_a_loop(spark, threshold, batch, part):
    rng = np.random.default_rng(batch)
    sizes = {"large": 150, "small": 5, "one": 1, None: 12}
    rows = [(g, int(i), [float(x) for x in rng.normal(size=6)]) for g, n in sizes.items() for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = dedup.greedy_dedup(df, threshold, "k", "v", "g", batch, part)
    assert got.columns == ["g", "k"]
    assert sorted((str(r["g"]), str(r["k"])) for r in got.collect()) == loop(spark_rows(df), threshold)


def test_one_group_and_a_chain(spark):
    angles = [i * 0.5 for i in range(40)]  # each is near to the one before and the one after alone, around the circle
    df = spark.createDataFrame([("x", i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], SCHEMA)
    got = [r["k"] for r in dedup.greedy_dedup(df, math.cos(0.7), "k", "v", batch=4, part=6).orderBy("k").collect()]
    assert [("x", str(k)) for k in sorted(map(str, got))] == [("x", k) for k in sorted(k for _, k in loop(spark_rows(df), math.cos(0.7)))]


def test_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("a", None, [0.0, 0.0]), ("a", 2, None), ("a", 3, []), ("a", 4, [2.0]), ("a", 5, [0.0, None]), ("a", 6, [0.0, 1.0, 0.0]), ("a", 6, [0.0, 3.0]), (None, 1, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", K2 string")
    for batch in (1, 2, 1000):
        got = dedup.greedy_dedup(df, 0.5, "k", "v", "g", batch, 2)
        assert sorted((str(r["g"]), str(r["k"])) for r in got.collect()) == loop(spark_rows(df), 0.5)
    assert dedup.greedy_dedup(df.limit(0), 0.5, "k", "v", "g").collect() == []
    with pytest.raises(ValueError):
        dedup.greedy_dedup(df, -0.1, "k", "v")

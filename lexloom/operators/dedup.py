"""Greedy dedup of vectors over whole tables: in order, a vector stays unless one that stayed before it is too near.

What stays hangs on what stayed before, so the fold is serial by its meaning; but a vector that stayed decides for all
later ones at once. Rounds use that. A round takes the first undecided vectors of each group (as many as fit a task), folds
them alone, and asks all later ones of the group whether one of those that stayed is too near. Whatever survives is
undecided in the next round. So rounds are as many as the largest group keeps batches, a group with fewer vectors than a
batch takes one, pairs are never listed, and the comparisons are those of the serial fold: each vector with those that
stayed before it.

A group of any size is spread: later vectors are dealt by (group, part), a part holds so many rows, and each part gets
the batch's kept vectors, which are no more than a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import Scratch

#: Vectors that a round folds in each group. Spark limits ranks up to a thousand before it shuffles them.
BATCH = 1000
#: Rows of a part of a group.
PART = 8000


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """A matrix of the vectors at unit length. Zero and null vectors, and places that a shorter one lacks, are zero."""
    rows = [np.zeros(0) if v is None else np.nan_to_num(np.asarray(v, float)) for v in vectors]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    norm = np.linalg.norm(out, axis=1)
    return out / np.where(norm == 0, 1, norm)[:, None]


def stays(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows the serial fold keeps. A row that is decided to stay strikes out all later ones that are too near."""
    open_ = np.ones(len(unit), bool)
    for i in range(len(unit)):
        if open_[i]:
            open_[i + 1 :] &= unit[i + 1 :] @ unit[i] <= threshold
    return open_


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


def greedy_dedup(vectors: DataFrame, threshold: float, order: str, vector: str, group: str | None = None, batch: int = BATCH, part: int = PART) -> DataFrame:
    """The rows (order, and group if there is one) that stay, by cosine over the threshold within their group.

    Rows of a null group are a group of their own. A null order comes first; rows of equal order stand in the order of
    the hashes of their vectors, and repeated rows are near to each other. Zero and null vectors are near to nothing, so
    they all stay; vectors of unequal length are compared as if the shorter one had zeros. Other columns are not looked at.
    """
    if not 0 <= threshold < 1:
        raise ValueError("a threshold lies between 0 and 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    key_type = vectors.schema[order].dataType.simpleString()
    group_type = vectors.schema[group].dataType.simpleString() if group else "int"
    given = F.col(group) if group else F.lit(0)
    fields = f"g {group_type}, k {key_type}, h bigint, n bigint, v array<double>"
    names = ["g", "k", "h", "n", "v"]
    rows = vectors.select(given.alias("g"), F.col(order).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("n", F.monotonically_increasing_id()).select(*names)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["k", "h", "n"], na_position="first")
        return frame[stays(unit_rows(frame["v"]), threshold)]

    def far(later: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if later.empty or kept.empty:
            return later[names]
        return later[names][(_product(unit_rows(later["v"]), unit_rows(kept["v"])) <= threshold).all(axis=1)]

    first = W.partitionBy("g").orderBy(F.col("k").asc_nulls_first(), "h", "n")
    out = []
    left = scratch.keep(rows)
    while True:
        taken = scratch.keep(left.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= batch).drop("r"))
        kept = scratch.keep(taken.groupBy("g").applyInPandas(fold, fields))
        out.append(kept.select("g", "k"))
        sizes = left.groupBy("g").agg(F.count("*").alias("m")).filter(F.col("m") > batch)
        if sizes.isEmpty():
            break
        parts = scratch.keep(sizes.select("g", F.ceil(F.col("m") / part).cast("int").alias("parts")))
        same = lambda a, b: a["g"].eqNullSafe(b["g"])
        later = left.join(taken.select("n"), "n", "left_anti")
        dealt = later.join(parts, same(later, parts)).select(*[later[c] for c in names], F.pmod(later["n"] + F.shiftright(later["n"], 33), parts["parts"]).cast("int").alias("p"))
        copied = kept.join(parts, same(kept, parts)).select(kept["g"], kept["v"], F.explode(F.sequence(F.lit(0), parts["parts"] - 1)).alias("p"))
        rest = scratch.keep(dealt.groupBy("g", "p").cogroup(copied.groupBy("g", "p")).applyInPandas(far, fields))
        scratch.drop(left, taken, parts)
        left = rest
    kept_rows = out[0]
    for more in out[1:]:
        kept_rows = kept_rows.unionByName(more)
    return kept_rows.select(*([F.col("g").alias(group)] if group else []), F.col("k").alias(order))

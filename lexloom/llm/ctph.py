"""Context-triggered piecewise hashing: a text's bytes are cut where a rolling hash of the last seven says so, and each
piece gives one character. A change moves only the cuts near it, so most characters of a changed text's signature stay.

A fingerprint is `size:signature:signature`: the block size (how many bytes a piece has on average), the signature at
that size and the one at twice the size. Fingerprints compare where their block sizes are equal or one is twice the
other: by the edit distance (insertions and deletions) of the signatures at a common size.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, slices

#: Bytes that the rolling hash looks back; the least block size, from which all others double; pieces of a signature.
WINDOW, LEAST, PIECES = 7, 3, 64
#: Signatures without a common run of this length (of a quarter of the shorter one, where that is less) are not alike.
RUN = 7
#: Bytes that are looked at together, which bounds the arrays of a long text.
STRIDE = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FACTOR, MIX = np.uint32(0x01000193), np.uint32(0x85EBCA6B)


def rolled(data: np.ndarray) -> np.ndarray:
    """One more than the hash of each window of seven bytes; windows lie within the data."""
    n = len(data) - WINDOW + 1
    wide = data.astype(np.uint32)
    h = wide[:n].copy()
    for i in range(1, WINDOW):
        h *= FACTOR
        h += wide[i : i + n]
    h ^= h >> np.uint32(15)
    h *= MIX
    h ^= h >> np.uint32(13)
    h >>= np.uint32(1)  # so that one more is no overflow
    h += np.uint32(1)
    return h


def _cuts(data: bytes, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each block size the ends of the first PIECES - 1 pieces; sizes double, and the cuts of one hold those of the next."""
    found = {s: np.zeros(0, np.int64) for s in sizes}
    for at in range(0, len(data) - WINDOW + 1, STRIDE):
        h = rolled(np.frombuffer(data, np.uint8, min(STRIDE + WINDOW - 1, len(data) - at), at))
        places = np.flatnonzero(h % np.uint32(sizes[0]) == 0)
        values = h[places]
        for s in sizes:
            if len(found[s]) < PIECES - 1:
                hit = places[values % np.uint32(s) == 0][: PIECES - 1 - len(found[s])]
                found[s] = np.concatenate([found[s], hit + at + WINDOW])
    return found


def _signature(data: bytes, cuts: np.ndarray) -> str:
    """A character for each piece; the last is whatever follows the last cut, and none if nothing does."""
    view, out, begin = memoryview(data), [], 0
    for end in [*cuts.tolist(), len(data)]:
        if end > begin:
            out.append(ALPHABET[zlib.crc32(view[begin:end]) & 63])
            begin = end
    return "".join(out)


def fingerprint_of(text: str) -> str:
    """The block size begins where the text has PIECES pieces at most if they are as long as expected, and is halved until
    there are half as many. The empty text has empty signatures.
    """
    data = text.encode("utf-8", "surrogatepass")
    size = LEAST
    while size * PIECES < len(data):
        size *= 2
    low = max(LEAST, size // 4)
    while True:
        sizes = [low << k for k in range((2 * size // low).bit_length())]
        found = _cuts(data, sizes)
        chosen = next((s for s in sizes[-2::-1] if s <= size and len(found[s]) >= PIECES // 2 - 1), None)
        if chosen or low == LEAST:
            break
        low = max(LEAST, low // 8)
    chosen = chosen or LEAST
    return f"{chosen}:{_signature(data, found[chosen])}:{_signature(data, found[2 * chosen])}"


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits: a bit for each character of a, a step for each of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    k = min(RUN, max(1, min(len(a), len(b)) // 4))
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not a or not b or not any(b[i : i + k] in runs for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness_of(a: str, b: str) -> float:
    """1 less the edit distance over the lengths of the signatures at a common block size, the better of two common sizes:
    1 for equal fingerprints, 0 where no size or no run of characters is common.
    """
    if a == b:
        return 1.0
    (s, a1, a2), (t, b1, b2) = a.split(":"), b.split(":")
    s, t = int(s), int(t)
    if s == t:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a1, b2) if s == 2 * t else _alike(a2, b1) if t == 2 * s else 0.0


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text; a null text is an empty one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint_of)

    return run(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1; null where one is null."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness_of(x, y) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return run(a, b)


#: What is told of a text and the one that follows it.
Report = Callable[[str, str], tuple]
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}


def with_next(docs: DataFrame, report: Report, fields: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *fields): report(text, text of the next document) of every document, in descending order of key.

    fields: the names and SQL types (bigint, string, double) of what report returns. After the last document comes the
    first, which is its own next if it is alone. Rows with equal keys stand in the order of the hashes of their texts,
    rows without a key last. Null texts are empty; columns besides key and text are not looked at; an empty table gives
    an empty one. Every text moves once: rows are dealt by ranges of (key, hash, place), so that no key is too large
    for a task, and a task walks its range with one row in hand. What is done is written together with the first and
    the last row of each range; those meet by the numbers of their ranges, and only numbers, one for each range, are
    ordered in one place.
    """
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("k").desc_nulls_last(), "h", "n"]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    made_type = pa.struct([(n, _ARROW[c]) for n, c in fields.items()])
    schema = f"part int, edge string, k {kind}, t string, made struct<{','.join(f'{n}:{c}' for n, c in fields.items())}>"

    def rows_of(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), key_type, pa.string(), made_type), strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["part", "edge", "k", "t", "made"])

    def told(t: str, after: str) -> dict:
        return dict(zip(fields, report(t, after), strict=True))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, key_type = TaskContext.get().partitionId(), None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for piece in slices(batch, 1, 2048):
                rows = []
                for k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    rows.append((part, None, held[0], None, told(held[1], t)) if held else (part, "first", None, t, None))
                    held = (k, t)
                yield rows_of(rows, key_type)
        if held:
            yield rows_of([(part, "last", *held, None)], key_type)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k, t, after = (batch.column(i)[row].as_py() for i in range(3))
                yield rows_of([(0, None, k, None, told(t, after))], batch.schema.field(0).type)

    walked = Scratch(docs.sparkSession).keep(dealt.mapInArrow(walk, schema))
    heads = walked.filter("edge = 'first'").select(F.col("part").alias("head"), F.col("t").alias("after"))
    lasts = walked.filter("edge = 'last'")
    ranges = W.orderBy("part")
    following = lasts.select("part", F.coalesce(F.lead("part").over(ranges), F.first("part").over(ranges)).alias("head"))
    met = lasts.select("part", "k", "t").join(following, "part").join(heads, "head").select("k", "t", "after").mapInArrow(meet, schema)
    return walked.filter("edge is null").unionByName(met).select(F.col("k").alias(key), *[F.col(f"made.`{n}`").alias(n) for n in fields])


def edited(text: str, after: str) -> str:
    """text, with its last half replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


EDIT_FIELDS = {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}

#: A text that was the next one is the first of the next call.
_recent = functools.lru_cache(2)(fingerprint_of)


def edit_report(text: str, after: str) -> tuple:
    """EDIT_FIELDS of a text and the next one."""
    changed = edited(text, after)
    own, other = _recent(text), fingerprint_of(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness_of(own, other), likeness_of(own, _recent(after))

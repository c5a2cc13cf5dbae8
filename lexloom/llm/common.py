"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import let
from lexloom.session import Scratch, checkpointed, remove, remove_at_end, shared_dir, shuffles_end

__all__ = ["SPACES", "Scratch", "checkpointed", "let", "put", "remove", "remove_at_end", "shared_dir", "shuffles_end", "slices", "words_of"]

#: White space between words: a space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words [^ space, 9-13]+ of a text; of null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """df with the given columns; a column of that name in any case that it already had gives way."""
    names = {c.lower() for c in cols}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[v.alias(k) for k, v in cols.items()])


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """batch in runs of so many rows and bytes of a text column at most; a longer text is a run of its own."""
    begin = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > begin and (i - begin >= rows or total + (n or 0) > size):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)

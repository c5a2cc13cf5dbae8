"""Token counts by a byte-level BPE vocabulary, for who wants a model's tokens rather than words.

Words between white space (text.count_tokens) are the default everywhere: they need no vocabulary and add up.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Splits text before merging: contractions, words, numbers, signs and white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def bpe_counter(spark: SparkSession, path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A function that counts a text's tokens. The driver alone reads the file; workers get its ranks."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else len(coder.encode_ordinary(t)))

    return count

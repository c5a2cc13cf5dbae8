"""Fill-in-middle: a text is cut at two places between its units and its parts are put in another order.

Units are matched left to right and cover the text, so a unit's end is all that is kept of it: the ends of a text lie
in one compact array, and a cut is a look-up in it. Where a text is cut and what form it gets hangs on its key and
the seed alone, so partitions, batches and other rows change nothing. A row needs no other row: one narrow step.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import put

#: A run of white space belongs to the word behind it; at the end of a text it is a unit of its own.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """The seed, how many of a hundred texts are rearranged, how many of a hundred of those suffix first, and the marks.

    A mark begins with a character that stands nowhere else in any mark, so that text beside a mark can make no other
    one and the first occurrence of a mark is the one that was put in.
    """

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = UNIT

    def __post_init__(self) -> None:
        marks = self.marks
        if len(set(marks)) < 3 or any(not m or any(m[0] in other[1:] for other in marks) for m in marks):
            raise ValueError("marks must differ, and none may hold the first character of one behind its own first")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points; the last end is the text's."""
    return array("Q", (m.end() for m in unit.finditer(text)))


def numbers_of(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers under 2^32 of a row's key: the first four groups of eight hexadecimal digits of its digest."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(text: str, key: object, plan: Plan, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    first, second, form, order = numbers_of(key, plan.seed)
    if not text or form % 100 >= plan.rate or any(m in text for m in plan.marks):
        return n, PLAIN, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = plan.prefix + text[:a], plan.middle + text[a:b], plan.suffix + text[b:]
    if order % 100 < plan.suffix_first:
        return n, SPM, a, b - a, suffix + prefix + middle
    return n, PSM, a, b - a, prefix + suffix + middle


def put_back(output: str, form: str, plan: Plan) -> str:
    """The text that an output was made of. Raises ValueError where marks are missing."""
    if form == PLAIN:
        return output
    order = {PSM: (plan.prefix, plan.suffix, plan.middle), SPM: (plan.suffix, plan.prefix, plan.middle)}[form]
    if not output.startswith(order[0]):
        raise ValueError(f"an output of form {form} begins with {order[0]}")
    second = output.index(order[1], len(order[0]))
    third = output.index(order[2], second + len(order[1]))
    one, two, middle = output[len(order[0]) : second], output[second + len(order[1]) : third], output[third + len(order[2]) :]
    return one + middle + two if form == PSM else two + middle + one


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(text: Column, key: Column, plan: Plan = Plan()) -> Column:
    """struct<n, form, prefix_chars, middle_chars, output, output_sha256> of a text; key seeds its cuts.

    A null text is an empty one, which has no units and is plain. A text that holds a mark is plain too. A null key
    seeds like the word null.
    """

    @F.pandas_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string,output_sha256:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(plan.unit)
        for texts, keys in batches:
            made = [rearranged(t, k, plan, unit) for t, k in zip(texts, keys, strict=True)]
            out = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}).assign(output_sha256=[_hex(m[-1]) for m in made])

    return run(F.coalesce(text, F.lit("")), F.coalesce(key.cast("string"), F.lit("null")))


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """struct<text, sha256>: the text that fill_in_middle() was given, from its output and form alone; null of a null."""

    @F.pandas_udf("struct<text:string,sha256:string>")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [None if o is None or f is None else put_back(o, f, plan) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [None if t is None else _hex(t) for t in texts]}, dtype=object)

    return run(output, form)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output and output_sha256 of each text; columns of these names give way.

    Repeated rows give equal outputs; an empty table gives an empty one. Whole texts are cut, however long.
    """
    made = put(docs, __made=fill_in_middle(F.col(text), F.col(key), plan))
    names = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    return put(made, **{n: F.col(f"__made.{n}") for n in names}).drop("__made")

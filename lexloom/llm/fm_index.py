"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents of one task. A filter of fixed size tells words that stand in the
benchmark; any other can be in no window and becomes a separator, and stretches of words shorter than the
shortest window shrink to nothing, which changes no answer. What is left is numbered by the shard's own
vocabulary and indexed: the Burrows-Wheeler transform, ranked by a wavelet matrix, with every 16th suffix position
kept. The corpus is read once: each shard's index is written to the shared folder, and all blocks of the
benchmark are asked of the written indexes. The windows of a block are searched backwards at once;
occurrences are located by walking to a kept position, and their words are merged into spans.

The benchmark is asked in blocks of a fixed size, so what is broadcast at a time doesn't grow with it. Removal
is repeated on the rows that were cut, over all blocks, until nothing is found.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

WINDOW = 10
#: Bytes of benchmark text asked and broadcast at a time, and of training text that a shard holds.
BLOCK_BYTES, SHARD_BYTES = 8_000_000, 8_000_000
KEEP_EVERY = 16
#: Bits of the filter, as a power of two: half a megabyte. Words that share one with a benchmark's are indexed for nothing.
FILTER_BITS = 22
#: Words whose number a task remembers.
KNOWN_WORDS = 2_000_000
#: Bytes of a word stay (A-Z in lower case), all others become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WaveletMatrix:
    """Ranks over symbols 0 ... sigma - 1, for many questions at a time."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.levels, self.bits = len(bits), bits
        self.ones = [np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32) for bit in bits]
        self.zeros = [len(bit) - int(ones[-1]) for bit, ones in zip(bits, self.ones, strict=True)]
        self.start = self._down(np.arange(2**self.levels), np.zeros(2**self.levels, np.int64))

    @classmethod
    def of(cls, symbols: np.ndarray, sigma: int) -> WaveletMatrix:
        bits, now = [], symbols
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            bits.append(bit)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        return cls(bits)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before at."""
        return self._down(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, ones = self.bits[k][at], self.ones[k][at]
            symbol = 2 * symbol + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while not new.all():
        first = np.flatnonzero(new)
        alone = np.zeros(n, bool)
        alone[first] = np.diff(np.append(first, n)) == 1
        ties = np.flatnonzero(~alone)
        at = order[ties]
        after = np.full(len(at), -1, np.int64)
        inside = at + k < n
        after[inside] = rank[at[inside] + k]
        head = rank[at]
        by = np.lexsort((after, head))
        at, head, after = at[by], head[by], after[by]
        order[ties] = at
        split = np.concatenate([[True], (head[1:] != head[:-1]) | (after[1:] != after[:-1])])
        new[ties] = split
        rank[at] = ties[np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))]
        k *= 2
    return order


class FMIndex:
    """Counts and locates phrases in symbols. Inside, symbols are one higher and a single 0 ends the text."""

    def __init__(self, wavelet: WaveletMatrix, before: np.ndarray, kept: np.ndarray, places: np.ndarray) -> None:
        self.n, self.wavelet, self.before = len(kept), wavelet, before
        self.kept, self.kept_rank, self.places = kept, np.cumsum(kept) - 1, places

    @classmethod
    def of(cls, symbols: np.ndarray, keep_every: int = KEEP_EVERY) -> FMIndex:
        text = np.append(symbols.astype(np.int64) + 1, 0)
        places = suffix_array(text)
        sigma = int(text.max()) + 1
        kept = places % keep_every == 0
        return cls(WaveletMatrix.of(text[places - 1], sigma), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]), kept, places[kept])

    def dump(self) -> bytes:
        return pickle.dumps((self.n, [np.packbits(b) for b in self.wavelet.bits], self.before, np.packbits(self.kept), self.places.astype(np.int32)), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        """What dump() wrote."""
        n, bits, before, kept, places = pickle.loads(data)
        return cls(WaveletMatrix([np.unpackbits(b, count=n) for b in bits]), before, np.unpackbits(kept, count=n).astype(bool), places.astype(np.int64))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each phrase; a row of phrases is padded at its end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        step = 0
        while len(alive := alive[(lengths[alive] > step) & (low[alive] < high[alive])]):
            symbol = phrases[alive, lengths[alive] - 1 - step] + 1
            known = symbol < len(self.before) - 1
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.before[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.rank(symbol, high[alive])
            step += 1
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, each walked back to one that is kept."""
        steps, rows, open_ = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(open_ := open_[~self.kept[rows[open_]]]):
            symbol, rank = self.wavelet.access(rows[open_])
            rows[open_] = self.before[symbol] + rank
            steps[open_] += 1
        return self.places[self.kept_rank[rows]] + steps


@dataclass(frozen=True)
class Windows:
    """The distinct windows of a block of the benchmark as numbers of its words, and the items that each stands in."""

    words: list[bytes]
    phrases: np.ndarray
    lengths: np.ndarray
    items: list
    owners: np.ndarray
    owner_at: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], window: int = WINDOW) -> Windows:
        vocabulary: dict[bytes, int] = {}
        names: dict[object, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[at : at + window]), set()).add(names.setdefault(item, len(names)))
        phrases = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            phrases[i, : len(p)] = p
        return cls(
            list(vocabulary),
            phrases,
            np.array([len(p) for p in found], np.int64),
            list(names),
            np.array([x for s in found.values() for x in sorted(s)], np.int64),
            np.concatenate([[0], np.cumsum([len(s) for s in found.values()])]).astype(np.int64),
        )


def _bit(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> (64 - FILTER_BITS)


@dataclass(frozen=True)
class Filter:
    """Bits of the benchmark's words, and the length of its shortest window (0: it asks nothing)."""

    bits: np.ndarray
    shortest: int

    @classmethod
    def of(cls, rows: DataFrame, window: int) -> Filter:
        """Of rows (i, t). At most 2 ** FILTER_BITS numbers come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least: dict[int, int] = {}
                for text in batch.column(0).to_pylist():
                    words = words_of(text)
                    for w in words:
                        least[_bit(w)] = min(least.get(_bit(w), window), len(words))
                yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int32())], names=["bit", "n"])

        got = rows.select("t").mapInArrow(run, "bit int, n int").groupBy("bit").agg(F.min("n").alias("n")).toArrow()
        bits = np.zeros(2**FILTER_BITS, bool)
        bits[got.column("bit").to_numpy()] = True
        return cls(np.packbits(bits), int(min(got.column("n").to_pylist(), default=0)))


class Numbers(dict):
    """A number for each word that passes the filter, in order of appearance from 1; 0 for others."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits, self.words = memoryview(bits.tobytes()), [b""]

    def __missing__(self, word: bytes) -> int:
        bit = _bit(word)
        number = 0
        if self.bits[bit >> 3] >> (7 - (bit & 7)) & 1:
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


@dataclass(frozen=True)
class Shard:
    """The index of a run of documents: n_words of each; and, of what is indexed, the words by number from 1, the places
    in the run's words (with one more after each document) and the index itself, or None if nothing is.
    """

    n_words: np.ndarray
    words: list[bytes]
    place: np.ndarray
    index: FMIndex | None

    @classmethod
    def of(cls, texts: list[bytes | None], numbers: Numbers, shortest: int) -> Shard:
        coded, sizes = [], []
        for text in texts:
            ids = np.fromiter(map(numbers.__getitem__, words := words_of(text)), np.int32, len(words))
            sizes.append(len(ids))
            coded += [ids, np.zeros(1, np.int32)]
        n_words = np.array(sizes, np.int64)
        whole = np.concatenate(coded) if coded else np.empty(0, np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (whole != 0).astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= max(1, shortest)
        begin, end = begin[long], end[long]
        if not len(begin) or not shortest:
            return cls(n_words, [], np.empty(0, np.int64), None)
        n = end - begin + 1  # with the separator behind it
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        used, symbols = np.unique(whole[place], return_inverse=True)  # the separator, 0, is the least
        return cls(n_words, [numbers.words[i] for i in used[1:].tolist()], place, FMIndex.of(symbols))

    def search(self, windows: Windows) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """(document, merged spans of hit words, numbers of items) of each document with a hit."""
        if self.index is None or not len(windows.lengths):
            return []
        own = dict(zip(self.words, range(1, len(self.words) + 1), strict=True))
        number = np.array([own.get(w, 0) for w in windows.words], np.int64)
        phrases = number[windows.phrases]
        inside = np.arange(phrases.shape[1]) < windows.lengths[:, None]
        asked = np.flatnonzero(((phrases > 0) | ~inside).all(axis=1))
        if not len(asked):
            return []
        low, high = self.index.search(phrases[asked], windows.lengths[asked])
        which = np.repeat(np.arange(len(asked)), high - low)
        if not len(which):
            return []
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(which))
        at, which = self.place[self.index.locate(rows)], asked[which]
        starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        depth = np.zeros(int(starts[-1]) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + windows.lengths[which], -1)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8)])))
        doc = np.searchsorted(starts, turn[::2], "right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in zip(doc.tolist(), turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
        items: dict[int, set[int]] = {d: set() for d in spans}
        for d, w in np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, which], axis=1), axis=0).tolist():
            items[d].update(windows.owners[windows.owner_at[w] : windows.owner_at[w + 1]].tolist())
        return [(d, spans[d], sorted(items[d])) for d in sorted(spans)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the first byte of a span's first word to the last of its last."""
    space = np.concatenate([[True], np.frombuffer(text.translate(_TABLE), np.uint8) == 32, [True]])
    edges = np.flatnonzero(np.diff(space.astype(np.int8)))
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without its spans."""
    parts, at = [], 0
    for a, b in _byte_spans(text, spans):
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


_SPANS = "array<struct<a:bigint,b:bigint>>"


class Benchmark:
    """A benchmark to be asked: its filter, and its windows block by block; a null item or text asks nothing."""

    def __init__(self, benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> None:
        rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).dropna()
        self.rows, self.window, self.kind = rows, window, rows.schema["i"].dataType.simpleString()
        self.n_blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
        self.filter = rows.sparkSession.sparkContext.broadcast(Filter.of(rows, window))
        self._one: Windows | None = None

    def blocks(self) -> Iterator[Windows]:
        if self._one:
            yield self._one
            return
        for b in range(self.n_blocks):
            part = self.rows if self.n_blocks == 1 else self.rows.filter(F.pmod(F.xxhash64("i"), F.lit(self.n_blocks)) == b)
            windows = Windows.of([(r["i"], bytes(r["t"])) for r in part.toLocalIterator()], self.window)
            if self.n_blocks == 1:
                self._one = windows
            yield windows


def _indexed(docs: DataFrame, asked: Benchmark, shard_bytes: int, scratch: Scratch) -> DataFrame:
    """The shards of docs (k, h, t), written: a row (shard, idx, k, h, n) for each document, and one with what Shard holds."""
    shared, shortest = asked.filter, asked.filter.value.shortest
    kinds = {"shard": pa.string(), "idx": pa.int32(), "k": None, "h": pa.int64(), "n": pa.int64(), "n_words": pa.binary(), "words": pa.binary(), "place": pa.binary(), "index": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers, task, number = Numbers(shared.value.bits), TaskContext.get().partitionId(), 0

        def made(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal numbers, number
            if len(numbers) > KNOWN_WORDS:
                numbers = Numbers(shared.value.bits)
            name = f"{task}-{number}"
            number += 1
            shard = Shard.of(table.column(2).to_pylist(), numbers, shortest)
            m = table.num_rows
            own = {"shard": pa.array([name] * m), "idx": pa.array(range(m), pa.int32()), "k": table.column(0), "h": table.column(1), "n": pa.array(shard.n_words)}
            yield pa.RecordBatch.from_arrays([own.get(c, pa.nulls(m, kind)) for c, kind in kinds.items()], names=list(kinds))
            if shard.index is not None:
                own = {"shard": name, "n_words": shard.n_words.tobytes(), "words": b" ".join(shard.words), "place": shard.place.tobytes(), "index": shard.index.dump()}
                yield pa.RecordBatch.from_arrays([pa.array([own.get(c)], kind or table.column(0).type) for c, kind in kinds.items()], names=list(kinds))

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            n = np.array([x or 0 for x in pc.binary_length(batch.column(2)).to_pylist()], np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff((size + np.cumsum(n)) // shard_bytes)) + 1, [len(n)]]) if len(n) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                held.append(batch.slice(int(a), int(b - a)))
                size += int(n[a:b].sum())
                if size >= shard_bytes:
                    yield from made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if len(table):
                yield from made(table.to_batches()[0])

    kind = docs.schema["k"].dataType.simpleString()
    return scratch.keep(docs.select("k", "h", "t").mapInArrow(run, f"shard string, idx int, k {kind}, h bigint, n bigint, n_words binary, words binary, place binary, index binary"))


def _hits(shards: DataFrame, asked: Benchmark, scratch: Scratch) -> DataFrame:
    """(shard, idx, spans, items) of documents with hits: each block of the benchmark is asked of the written indexes."""
    rows = shards.filter("index is not null").select("shard", "n_words", "words", "place", "index")

    def answers(windows: Windows) -> DataFrame:
        shared = shards.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, n_words, words, place, index in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    shard = Shard(np.frombuffer(n_words, np.int64), words.split(b" "), np.frombuffer(place, np.int64), FMIndex.load(index))
                    for idx, spans, items in shard.search(shared.value):
                        yield pa.RecordBatch.from_pylist([{"shard": name, "idx": idx, "spans": [{"a": a, "b": b} for a, b in spans], "items": [shared.value.items[i] for i in items]}], schema)

        return scratch.keep(rows.mapInArrow(run, f"shard string, idx int, spans {_SPANS}, items array<{asked.kind}>"))

    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = to_arrow_type(asked.rows.schema["i"].dataType)
    schema = pa.schema([("shard", pa.string()), ("idx", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(item_kind))])
    found = [answers(w) for w in asked.blocks()]
    if len(found) == 1:
        return found[0]
    grouped = reduce(DataFrame.unionAll, found).groupBy("shard", "idx").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in x])] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, schema.field("spans").type), batch.column(3)], names=schema.names)

    return grouped.mapInArrow(joined, f"shard string, idx int, spans {_SPANS}, items array<{asked.kind}>")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each row of docs: key, n_words, n_hit, spans of hit words (from, to), items and contaminated.

    A null text has no words. Rows that repeat are reported each. Texts of any length are searched whole,
    an empty benchmark hits nothing, and an empty table gives an empty result. Items may be of any type that
    can be ordered. Benchmark rows without an id or without words ask nothing; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    asked = Benchmark(benchmark, item, item_text, window, block_bytes)
    held = docs.select(F.col(f"`{key}`").alias("k"), F.lit(0).cast("bigint").alias("h"), F.col(f"`{text}`").cast("binary").alias("t"))
    shards = _indexed(held, asked, shard_bytes, scratch)
    found = shards.filter("idx is not null").select("shard", "idx", "k", "n").join(_hits(shards, asked, scratch), ["shard", "idx"], "left")
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    items = F.coalesce("items", F.array().cast(f"array<{asked.kind}>"))
    hits = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return found.select(F.col("k").alias(key), F.col("n").alias("n_words"), hits.alias("n_hit"), spans.alias("spans"), items.alias("items"), F.col("spans").isNotNull().alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with hit spans cut out of the text; its own columns, and n_chars, where there is one, follows.

    Untouched texts stay to the byte. A document goes if it had hits and no word is left. What a cut brings
    together is searched again, over the whole benchmark, until no window is left. Nulls, ties and items as in
    contamination(); rows are told apart by key and text, and equal ones are cut alike.
    """
    scratch = Scratch(docs.sparkSession)
    asked = Benchmark(benchmark, item, item_text, window, block_bytes)
    names = [f"__{i}" for i in range(len(docs.columns))]
    t, k = names[docs.columns.index(text)], names[docs.columns.index(key)]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def hit(rows: DataFrame) -> DataFrame:
        """(k, h, spans) of rows with hits."""
        shards = _indexed(rows.select(F.col(k).alias("k"), F.xxhash64(t).alias("h"), F.col(t).cast("binary").alias("t")), asked, shard_bytes, scratch)
        found = shards.filter("idx is not null").select("shard", "idx", "k", "h").join(_hits(shards, asked, scratch), ["shard", "idx"])
        out = scratch.keep(found.select("k", "h", "spans").dropDuplicates(["k", "h"]))
        scratch.drop(shards)
        return out

    def same(hits: DataFrame):
        return F.col(k).eqNullSafe(hits["k"]) & (F.xxhash64(t) == hits["h"])

    @F.udf("string", useArrow=True)
    def shortened(x, spans):
        return cut(x.encode("utf-8", "surrogatepass"), [(s["a"], s["b"]) for s in spans]).decode("utf-8", "surrogatepass")

    hits = hit(held)
    clean = held.join(hits, same(hits), "left_anti")
    dirty = held.join(hits, same(hits))
    while True:
        dirty = scratch.keep(dirty.select(*[shortened(F.col(t), F.col("spans")).alias(n) if n == t else F.col(n) for n in names]))
        more = hit(dirty)
        if more.isEmpty():
            break
        left = dirty.join(more, same(more), "left")
        dirty = left.withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    dirty = dirty.filter(F.col(t).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    if "n_chars" in docs.columns:
        n_chars = names[docs.columns.index("n_chars")]
        dirty = dirty.withColumn(n_chars, F.length(t).cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(dirty.select(*names)).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])

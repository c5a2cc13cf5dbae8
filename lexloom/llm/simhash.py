"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; their bit counts are its point on an
integer grid. The Manhattan distance of two points never exceeds the Hamming distance of their
fingerprints, so pairs within radius r lie in points within r. The grid's coordinates form r + 3
groups: r steps can leave at most r groups, so such points share a cell of the sub-grid of some three
groups. Every fingerprint is filed under the cell of each choice of three groups; the fingerprints of
a cell are compared first by Manhattan distance, then exactly.

Equal fingerprints are one point from the start. Of the pairs found in a cell only a spanning forest
leaves the task, and rows that are already linked are not compared again. A cell of more than BLOCK
fingerprints is cut into blocks, and every two blocks meet in a task of their own, so no cell is gathered
whole and none is capped. What is written for a step is removed when the next has read it.

Wide fingerprints (16 words of 64 bits) serve lower similarities, where a radius is too large for popcount
cells to tell anything: there the cells are the bits of single segments, the bit counts of the words give
the lower bound, and components of what is left are checked on the shingles themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, slices
from lexloom.llm.graph import components

#: Fingerprints of a block of a cell; 48 bytes each.
BLOCK = 4096
#: Sets of fewer shingles are too small for their fingerprints to tell: they are compared as they are.
FEW = 8
#: Odd multipliers that derive further words from a shingle's hash (fractions of the golden ratio and roots).
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, size: int, hash_of) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([hash_of(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    return np.array([hash_of(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    if word:
        h = h ^ np.uint64(word * _MIX[3] % 2**64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX[word % 3])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[(word + 1) % 3])
        h = h ^ (h >> np.uint64(32))
    return h


_LANES = np.uint64(0x0101010101010101)


def fingerprints(hashes: list[np.ndarray], words: int = 1) -> np.ndarray:
    """(documents, words) of uint64: a bit is 1 if set in over half of a document's hashes. No hash: zero."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), words), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    n = sizes[full]
    pieces = -(-n // 255)  # a byte lane holds 255 counts
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    cuts = np.repeat(begins, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for w in range(words):
        h = _mixed(flat, w)
        bits = np.empty((len(full), 64), bool)
        for j in range(8):  # bits j, j + 8, ... in the eight byte lanes
            lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, cuts)
            counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            bits[:, j::8] = 2 * counts > n[:, None]
        out[full, w] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_column(docs: DataFrame, key: str, text: str, size: int, words: int = 1, column: str = "fp", distinct: bool = False) -> DataFrame:
    """(key, fp0, fp1, ...) for each row of docs, as signed longs.

    distinct: of the set of shingles, without repeats, and after the key a column node: a hash of the sorted set,
    null without a word.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, 1):
                hashes = [shingle_hashes(x, size, xxhash.xxh64_intdigest) for x in part.column(1).to_pylist()]
                if distinct:
                    hashes = [np.unique(h) for h in hashes]
                got = fingerprints(hashes, words).view(np.int64)
                cols = [part.column(0), *(pa.array(got[:, w]) for w in range(words))]
                if distinct:
                    sets = [xxhash.xxh64_intdigest(h.tobytes(), 42) if len(h) else None for h in hashes]
                    cols.insert(1, pa.array([x if x is None else x - 2**64 * (x >= 2**63) for x in sets], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names=[key, *["node"][: int(distinct)], *(f"{column}{w}" for w in range(words))])

    schema = f"`{key}` {kind}, " + "node bigint, " * distinct + ", ".join(f"{column}{w} bigint" for w in range(words))
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def popcounts(fp: np.ndarray, width: int = 2) -> np.ndarray:
    """(n, 64 / width) bit counts of the segments of one word each."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), 64 // width, width).sum(axis=2, dtype=np.uint8)


def grid_cells(fp: np.ndarray, radius: int) -> np.ndarray:
    """(n, choices) of cell keys such that points within radius share one."""
    points = popcounts(fp).astype(np.int64)
    groups = np.array_split(np.arange(points.shape[1]), radius + 3)
    cells = []
    for number, chosen in enumerate(itertools.combinations(groups, 3)):
        key = np.full(len(fp), number, np.int64)
        for c in np.concatenate(chosen):
            key = key * 3 + points[:, c]
        cells.append(key)
    return np.stack(cells, axis=1)


def band_cells(fp: np.ndarray, width: int = 16) -> np.ndarray:
    """(n, bands) of cell keys: the bits of each segment of a wide fingerprint."""
    parts = fp.view("<u2").astype(np.int64) if width == 16 else fp.view("<u4").astype(np.int64)
    return parts * 4096 + np.arange(parts.shape[1])


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after joining every a with its b; roots are least members."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _sides(table: pa.Table) -> np.ndarray:
    """1 and 2 for the two sides of a pair of blocks, 0 for rows that all meet each other."""
    return pc.add(pc.fill_null(pc.cast(table.column("side"), pa.int8()), -1), 1).to_numpy()


def linked(cell: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that span the links inside cells. Rows are sorted by cell; those of one side, 1 or 2, don't meet."""
    ids, local = np.unique(node, return_inverse=True)
    root = np.arange(len(ids))
    # a point: bit counts of segments; its Manhattan distance bounds the Hamming distance from below
    points = popcounts(np.ascontiguousarray(fp[:, 0])) if fp.shape[1] == 1 else np.bitwise_count(fp)
    points = points.astype(np.int8 if fp.shape[1] == 1 else np.int16)
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    number = np.cumsum(np.concatenate([[True], cell[1:] != cell[:-1]])) - 1
    at, d = np.arange(len(cell)), 0
    while True:
        d += 1
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        if d & (d - 1) == 0:  # now and then: cells that are one class have no more to tell
            own = root[local]
            mixed = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins)
            at = at[mixed[number[at]]]
        if not len(at):
            return ids, ids[root]
        for lo in range(0, len(at), 200_000):
            i = at[lo : lo + 200_000]
            i = i[root[local[i]] != root[local[i + d]]]
            if side is not None:
                i = i[(side[i] == 0) | (side[i] != side[i + d])]
            i = i[np.abs(points[i] - points[i + d]).sum(axis=1, dtype=np.int64) <= radius]
            i = i[_ones(fp[i] ^ fp[i + d]) <= radius]
            root = _merged(root, local[i], local[i + d])


def _meeting(rows: DataFrame, group: str, large: DataFrame) -> DataFrame:
    """rows (group, node, ...), those of large (group, blocks) once for each pair of blocks that theirs is in;
    cell tells the group, or the pair, and side which block of two a row is of: those of one side meet elsewhere.
    """
    rest = [c for c in rows.columns if c != group]
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("__own", j).alias("i"), F.greatest("__own", j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return (
        rows.join(large, group, "left")
        .withColumn("__own", own)
        .select(group, "__own", *rest, F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(meets)).alias("__m"))
        .select(F.xxhash64(group, "__m.i", "__m.j").alias("cell"), F.when(F.col("__m.i") != F.col("__m.j"), F.col("__own") == F.col("__m.i")).alias("side"), *rest)
    )


def _by_cell(rows: DataFrame, judge) -> DataFrame:
    """Edges (a, b) that judge finds in whole cells of rows: it gets a table of whole cells, sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last cell of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            a, b = judge(table)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cell = table.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1], "left"))
            if whole:
                yield out(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def _prints(table, names: list[str]) -> np.ndarray:
    """The fingerprints in the columns named, which are words of 64 bits."""
    return np.ascontiguousarray(np.stack([table.column(n).to_numpy() for n in names], axis=1)).view(np.uint64)


def links(points: DataFrame, words: int, radius: int, cells, carried: int | None = None) -> DataFrame:
    """Edges (a, b) that span the links among points (node, fp0, ...), one row for each node.

    cells: gives the cell keys of an array of fingerprints of so many words. carried: how many of the
    words go along and are compared; radius is meant for those.
    """
    names = [f"fp{w}" for w in range(words)]
    own = names[: carried or words]

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = cells(_prints(part, names))
                rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                cols = [pa.array(keys.ravel()), part.column(0).take(rows), *(part.column(n).take(rows) for n in own)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "node", *own])

    rows = points.select("node", *names).mapInArrow(filed, "key bigint, node bigint, " + ", ".join(f"{n} bigint" for n in own))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                keys, n = np.unique(cells(_prints(batch.slice(at, 2048), names)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    sums = points.select(*names).mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    large = sums.filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))

    def judge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, root = linked(table.column("cell").to_numpy(), table.column("node").to_numpy(), _prints(table, own), radius, _sides(table))
        far = node != root
        return node[far], root[far]

    return _by_cell(_meeting(rows, "key", large), judge)


def _classes(points: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component_id): the least key, low, of all that edges reach."""
    roots = components(edges)
    rooted = scratch.keep(points.select("node", "low").join(roots, "node").select("node", "low", "root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    reached = scratch.keep(rooted.join(least, "root").select("node", "component_id"))
    scratch.drop(rooted)
    return points.select("node", "low").join(reached, "node", "left").select("node", F.when(F.col("component_id").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for each row of docs.

    A document of fewer words than a shingle is one shingle; one with no word, or a null text, has
    fingerprint zero and is linked like any other. Keys must be integers; rows that repeat a key stay
    rows. A null key is no candidate for component_id, which is null where only such keys are linked.
    An empty table gives an empty result; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep(fingerprint_column(docs, key, text, size).select(f"`{key}`", F.col("fp0").alias("node"), "fp0").hint("rebalance"))
    points = scratch.keep(marked.groupBy("node").agg(F.min(f"`{key}`").alias("low"), F.first("fp0").alias("fp0")))
    edges = scratch.keep(links(points, 1, radius, lambda fp: grid_cells(fp[:, 0].copy(), radius)))
    joined = marked.join(_classes(points, edges, scratch), "node")
    return joined.select(f"`{key}`", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


#: A component of more texts than TEXT_BLOCK is checked in blocks, of which up to SPREAD spread the work; beyond that
#: there are as many as memory asks for: a block has so many bytes or rows at most. Each text is written once a block.
SPREAD, TEXT_ROWS = 16, 8192
#: Wide fingerprints: words of 64 bits, of which so many are compared within cells.
WIDE_WORDS, CARRIED, SIMILARITY, TEXT_BLOCK, TEXT_BYTES = 16, 4, 0.8, 512, 8_000_000


def wide_radius(similarity: float, words: int, deviations: float = 3.3) -> int:
    """Differing bits that shingle sets of this Jaccard similarity or more do not exceed, but for one in two thousand."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * words
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def alike(texts: list[str | None], node: np.ndarray, fp: np.ndarray, radius: int, size: int, similarity: float, side: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of nodes that span the links between texts whose shingle sets have that Jaccard similarity; sides as in linked()."""
    import xxhash

    sets = [np.unique(shingle_hashes(t, size, xxhash.xxh64_intdigest)) for t in texts]
    n = np.array([len(x) for x in sets])
    root = np.arange(len(texts))
    a, b = [], []
    for i in range(len(texts) - 1):
        far = _ones(fp[i + 1 :] ^ fp[i])
        near = np.flatnonzero(((far <= radius) | (np.minimum(n[i + 1 :], n[i]) < FEW)) & (root[i + 1 :] != root[i]) & (node[i + 1 :] != node[i]) & ((side[i] == 0) | (side[i + 1 :] != side[i])))
        near = near[np.argsort(far[near], kind="stable")] + i + 1  # the likeliest first: what they link needs no look
        near = near[np.minimum(n[near], n[i]) >= similarity * np.maximum(n[near], n[i])]
        step = 8
        while len(near):
            some, near, step = near[:step], near[step:], 2 * step
            flat = np.concatenate([sets[j] for j in some.tolist()])
            place = np.searchsorted(sets[i], flat)
            same = sets[i][np.minimum(place, n[i] - 1)] == flat
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(n[some]) - n[some])
            for j in some[both >= similarity * (n[i] + n[some] - both)].tolist():
                if root[i] != root[j]:
                    a.append(int(node[i]))
                    b.append(int(node[j]))
                    root[root == root[j]] = root[i]
            near = near[root[near] != root[i]]
    return a, b


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id) with links between documents whose sets of shingles have that Jaccard similarity.

    Candidates are found by wide fingerprints: pairs that share a segment's bits and whose carried words
    are as near as the similarity makes them. Texts of equal sets are one node: its name is a hash of the
    set, not the fingerprint, which one frequent shingle can make up. Components are then checked exactly, on the sets
    themselves, in blocks that meet pair by pair. A pair at the very similarity shares a segment with
    probability 0.992, a closer one with more; of sets of four and five shingles, 0.82. Nulls, ties and repeats as in near_duplicates(), except that
    documents with no word, about which shingles say nothing, are left out.
    """
    names = [f"fp{w}" for w in range(WIDE_WORDS)]
    radius = wide_radius(similarity, CARRIED)
    held = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    tagged = held.select(F.struct("key", F.xxhash64("text").alias("h")).alias("key"), "text")
    # of sets, as the measure is: repeats would part the fingerprints of texts that differ in their number alone
    scratch = Scratch(docs.sparkSession)
    found = fingerprint_column(tagged, "key", "text", size, WIDE_WORDS, distinct=True)
    worded = found.filter("node is not null")
    # fingerprints are far smaller than texts: fewer files than the texts have partitions
    marked = scratch.keep(worded.select("key", "node", *names).hint("rebalance"))
    points = scratch.keep(marked.groupBy("node").agg(F.min("key").alias("low"), *(F.first(n).alias(n) for n in names)))
    edges = scratch.keep(links(points, WIDE_WORDS, radius, band_cells, CARRIED))
    loose = components(edges)
    asked = points.join(loose, "node").select(F.col("low.key").alias("key"), F.col("low.h").alias("h"), "node", "root", *names)
    sized = held.select("key", F.xxhash64("text").alias("h"), "text").join(asked, ["key", "h"])
    texts = scratch.keep(sized.select("root", "node", *names, "text"))
    sums = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    spread = F.least(F.col("n") / TEXT_BLOCK, F.lit(float(SPREAD)))
    blocks = F.ceil(F.greatest(spread, F.col("n") / TEXT_ROWS, F.col("bytes") / TEXT_BYTES)).cast("int")
    large = sums.select("root", blocks.alias("blocks")).filter("blocks > 1")
    whole = wide_radius(similarity, WIDE_WORDS)

    def judge(table: pa.Table) -> tuple[list[int], list[int]]:
        cell, node, fp = table.column("cell").to_numpy(), table.column("node").to_numpy(), _prints(table, names)
        side = _sides(table)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1:
                x, y = alike(table.column("text").slice(lo, hi - lo).to_pylist(), node[lo:hi], fp[lo:hi], whole, size, similarity, side[lo:hi])
                a += x
                b += y
        return a, b

    exact = scratch.keep(_by_cell(_meeting(texts, "root", large), judge))
    scratch.drop(texts, edges)
    classes = _classes(points.select("node", F.col("low.key").alias("low")), exact, scratch)
    return marked.select(F.col("key.key").alias(key), "node").join(classes, "node").select(f"`{key}`", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those that another document of a smaller key stands for, by similar_classes(); its own columns.

    Rows that repeat a key whole stay or go together; rows with a null key or no word stay.
    """
    classes = similar_classes(docs.filter(F.col(f"`{key}`").isNotNull()), key, text, **options)
    gone = classes.filter(F.col(f"`{key}`") > F.col("component_id")).select(F.col(f"`{key}`").alias("__gone")).distinct()
    held = docs.withColumn("__key", F.col(f"`{key}`"))
    return held.join(gone, F.col("__key") == F.col("__gone"), "left_anti").drop("__key")

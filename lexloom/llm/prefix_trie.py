"""The trie of conversations' prefixes, built level by level, and what is saved if each shared prefix is held once.

Downwards: at each depth the conversations that are still live are grouped by (parent node, next turn); a group is a
node, named by the least conv_id in it. A conversation that is alone in its node shares nothing from there on, so it
leaves the live ones and the rest of it is a chain of nodes known without grouping. The levels that Spark walks are
therefore as many as turns are shared, not as many as the longest conversation has. Upwards: from the deepest level
on, each level's nodes are joined with sums over their children.

A level is one written table, so lineage stays short. Groups are summed before any shuffle; what is joined back is a
plain join of two exchanged sides, so that a hot turn or a hot conversation can be split at run time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, checkpointed

NOTHING = hashlib.sha256(b"").hexdigest()
#: Conversations of so many consecutive ids start with turns of the first of them, 0 to HEADS - 1 of its turns.
BLOCK, HEADS = 100, 6


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, chars): the place of each turn in its conversation, from 1, by turn, null first.

    turn_key is a digest of 128 bits of role and text, of which nulls are empty ones; turns that tie stand in the order
    of their digests, so repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are
    left out. Texts don't move, and a conversation may lie in many tasks: rows are dealt by ranges and numbered within
    them, and each range of a conversation is told how many rows of it the ranges before hold.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    plain = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint"), "turn", key.alias("turn_key"), F.length(text).cast("bigint").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "turn_key", "n"]
    dealt = plain.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.select("conv_id", "turn_key", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("begin"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("conv_id", "part", (before - F.col("begin") + 1).alias("shift"))
    return placed.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "turn_key", "chars")


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_key, chars) and (conv_id, n_turns): every conversation c begins with the first h turns of
    c - c % block, h = crc32 of its decimal id % heads, followed by its own turns after its first h.

    A conversation that is left without turns is in the second table only.
    """
    own = checkpointed(numbered(turns))
    ids = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    drawn = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    meta = ids.select("conv_id", "own", drawn("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    lengths = ids.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    known = meta.join(lengths, "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0))))
    sizes = checkpointed(known.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")))
    lent = own.filter((F.col("conv_id") % block == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    head = sizes.filter("given > 0").join(lent, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "turn_key", "chars")
    rest = own.filter(F.col("pos") > drawn("conv_id")).join(sizes.select("conv_id", "h", "given"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "turn_key", "chars")
    return head.unionByName(rest), sizes.select("conv_id", "n_turns")


def ends_of(ended: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): the digest of the ids in ascending order. It is serial by its
    meaning; a node's ids are sorted by Spark, which can spill, and hashed as they come, with constant state.
    """
    schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, rows = None, None, []
        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (depth, node):
                    digest.update(b",%d" % conv)
                    continue
                if now:
                    rows.append((*now, digest.hexdigest()))
                now, digest = (depth, node), hashlib.sha256(b"%d" % conv)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if now:
            rows.append((*now, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return ended.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(run, "depth bigint, node bigint, ends_sha256 string")


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) for each distinct sequence of first turns.

    turns: (conv_id, depth, turn_key, chars), depth from 1 without gaps. sizes: (conv_id, n_turns) of all conversations,
    those without turns included, which are members of the root alone. conv_id of a node is its least member, and
    names it within its depth. Empty tables give no node, not even a root.
    """
    scratch = Scratch(turns.sparkSession)
    order = ["depth", "conv_id"]
    lying = scratch.keep(turns.repartitionByRange(*order).sortWithinPartitions(*order))
    root = scratch.keep(sizes.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).filter("n_convs > 0").select("node", F.lit(None).cast("bigint").alias("parent"), "n_convs", F.lit(0).cast("bigint").alias("chars")))
    if root.isEmpty():
        return _told(root.select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("n_children"), F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.lit(NOTHING).alias("ends_sha256"), "*"))
    top = root.first()["node"]
    live = scratch.keep(sizes.select("conv_id", "n_turns", F.lit(top).cast("bigint").alias("node")))
    levels, alone, ended = [root], [], [_ended(live, 0)]
    while True:
        depth = len(levels)
        going = live.filter(F.col("n_turns") >= depth)
        said = lying.filter(F.col("depth") == depth).select("conv_id", "turn_key", "chars")
        steps = scratch.keep(going.select("conv_id", "n_turns", F.col("node").alias("parent")).join(said, "conv_id"))
        if steps.isEmpty():
            break
        nodes = scratch.keep(steps.groupBy("parent", "turn_key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("n_turns").alias("n_turns")))
        single = F.col("n_convs") == 1
        alone.append(nodes.filter(single).select(F.col("node").alias("conv_id"), F.lit(depth).cast("bigint").alias("since"), "parent", "n_turns"))
        shared = nodes.filter(~single)
        levels.append(shared.select("node", "parent", "n_convs", "chars"))
        live = scratch.keep(steps.join(shared.select("parent", "turn_key", "node"), ["parent", "turn_key"]).select("conv_id", "n_turns", "node"))
        ended.append(_ended(live, depth))
        scratch.drop(steps)
    return _told(_rolled_up(scratch, levels, alone).join(ends_of(_all(ended)), ["depth", "node"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))).unionByName(_chains(lying, alone))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _ended(live: DataFrame, depth: int) -> DataFrame:
    return live.filter(F.col("n_turns") == depth).select(F.lit(depth).cast("bigint").alias("depth"), "node", "conv_id")


def _rolled_up(scratch: Scratch, levels: list[DataFrame], alone: list[DataFrame]) -> DataFrame:
    """Shared nodes with n_children, n_leaves and saved_tokens, from the deepest level to the root."""
    out: list[DataFrame] = []
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        children = [alone[depth].select("parent", F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))] if depth < len(alone) else []
        children += [below.select("parent", "n_leaves", "saved_tokens")] if below is not None else []
        own = (F.col("n_convs") - 1) * F.col("chars")
        if children:
            sums = _all(children).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
            joined = levels[depth].join(sums, "node", "left")
        else:
            joined = levels[depth].select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "below")])
        below = scratch.keep(joined.select(F.lit(depth).cast("bigint").alias("depth"), "node", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"), (own + F.coalesce("below", F.lit(0))).cast("bigint").alias("saved_tokens")))
        out.append(below)
    return _all(out)


def _told(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _chains(turns: DataFrame, alone: list[DataFrame]) -> DataFrame:
    """The nodes that one conversation has for itself, from where it left the live ones to its end."""
    if not alone:
        return _told(turns.limit(0).select("depth", F.col("conv_id").alias("node"), F.col("conv_id").alias("parent"), *[F.lit(0).cast("bigint").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit(NOTHING).alias("ends_sha256")))
    rows = turns.select("conv_id", "depth").join(_all(alone), "conv_id").filter("depth >= since")
    last = F.col("depth") == F.col("n_turns")
    one = F.lit(1).cast("bigint")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """trie() of the conversations that rebuilt() makes of turns (conv_id, turn, role, text); other columns are not looked at."""
    return trie(*rebuilt(turns, block, heads))

"""The trie of conversations' beginnings, with sums over subtrees by heavy-path decomposition.

A turn is named by SHA-256 of role and text, a beginning by its length and the exclusive or of 128-bit digests of
(place, turn): two different beginnings bear one name with a chance of 2^-128. So a beginning's parent follows from its
own row, and no text is moved. Running values within a conversation are taken in blocks of BLOCK places and carried from
block to block, so that one task gets a long conversation's blocks, never its turns.

A node's heavy child is the one with most members (ties: the smallest member); each other child has half of them at most,
so that no way from the root has more light edges than the logarithm of the number of conversations. A heavy path ends in
a childless node; the smallest conversation that ends there passes through all of it. Rounds go from the paths with most
light edges above them to the root's: values are summed from a path's end upwards, and the sum at its head is added to
the head's parent, which lies on a path of the next round.

Null role or text: empty. Null turn: first. Turns of equal number come in the order of their digests, repeated rows one
after another. Rows without a conv_id take no part. c - c % n is taken as Spark and SQL do, towards zero. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import attach, cut, number_rows, partitions

BLOCK = 1 << 10
IDS = 1 << 12  # conversations' numbers joined before they are sent
NODE = ["depth", "a", "b"]
PARENT = ["up_depth", "up_a", "up_b"]


def _lanes(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, i, 16), 16, -10).cast("long") for i in (1, 17)]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, bytes of each turn, n (turns) and first 8 turns known by place."""
    role, text = F.coalesce(F.col("role"), F.lit("")).cast("string"), F.coalesce(F.col("text"), F.lit("")).cast("string")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    return number_rows(rows, "conv_id", "turn", "digest", name="at").select("conv_id", "at", "digest", "bytes")


def rebuilt(conversations: DataFrame, span: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, digest, bytes, size (turns in all) of each turn of the conversations rebuilt; and conv_id, size of each.

    Conversation c takes the first h turns of conversation c - c % span, then its own after its first h;
    h is the CRC-32 of its number modulo most + 1. span 1 leaves conversations as they are."""
    own = turns(conversations)
    heads = own.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    lend = heads.select(F.col("conv_id").alias("lender"), F.least("held", F.lit(most)).alias("lent"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    every = heads.withColumn("lender", F.col("conv_id") - F.col("conv_id") % span).withColumn("h", h).join(lend, "lender", "left")
    every = every.withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    every = cut(every.withColumn("size", F.col("lent") + F.greatest(F.lit(0), F.col("held") - F.col("h"))))
    met = attach(own, every.select("conv_id", "first", "h", "lent", "size", "held"), "conv_id").withColumn("place", F.col("at") - F.col("first") + 1)
    kept = met.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "digest", "bytes", "size")
    leads = met.where((F.col("place") <= most) & (F.col("conv_id") % span == 0)).select(F.col("conv_id").alias("lender"), "place", "digest", "bytes")
    taken = leads.join(every.select("conv_id", "lender", "lent", "size"), "lender").where("place <= lent")  # span conversations take most turns at most
    taken = taken.select("conv_id", F.col("place").alias("depth"), "digest", "bytes", "size")
    return kept.unionByName(taken), every.select("conv_id", "size")


def beginnings(rows: DataFrame) -> DataFrame:
    """Each turn's row with a, b, up_a, up_b: the names of the beginnings that end with it and before it."""
    x, y = _lanes(F.concat_ws(":", "depth", "digest"))
    rows = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "bytes", "size", x.alias("x"), y.alias("y"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("a", F.bit_xor("x").over(upto)).withColumn("b", F.bit_xor("y").over(upto))
    whole = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK turns
    carried = whole.select("conv_id", "block", F.bit_xor("x").over(before).alias("from_a"), F.bit_xor("y").over(before).alias("from_b")).where("block > 0")
    met = inside.join(carried, ["conv_id", "block"], "left")
    a, b = (F.col(c).bitwiseXOR(F.coalesce(f"from_{c}", F.lit(0))) for c in "ab")
    return met.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"), "bytes", (F.col("depth") == F.col("size")).alias("last"))


def nodes(rows: DataFrame, every: DataFrame) -> DataFrame:
    """depth, a, b, conv_id (the smallest member), n_convs, bytes (of the last text), the parent's name."""
    deep = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    deep = deep.withColumn("up_depth", F.col("depth") - 1)
    none = F.lit(0).cast("long")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[none.alias(c) for c in NODE], "conv_id", "n_convs", none.alias("bytes"), none.alias("up_a"), none.alias("up_b"), F.lit(-1).cast("long").alias("up_depth"))
    return deep.unionByName(root)


def linked(tree: DataFrame) -> DataFrame:
    """nodes() with parent_conv_id, n_children and light (not its parent's heavy child)."""
    kids = tree.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("held"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("less"))).alias("most"))
    kids = kids.select(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True)], "held", F.bitwise_not("most.less").alias("heavy"))
    own = tree.join(kids, NODE, "left").withColumn("n_children", F.coalesce("held", F.lit(0)))
    up = own.where("held is not null").select(*[F.col(n).alias(p) for p, n in zip(PARENT, NODE, strict=True)], F.col("conv_id").alias("parent_conv_id"), "heavy", "held")
    met = attach(own.drop("held", "heavy"), up, *PARENT)  # a node's children may be a third of all nodes
    return met.withColumn("light", F.coalesce(F.col("conv_id") != F.col("heavy"), F.lit(False))).drop("heavy")


def paths(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """linked() with path (its end's smallest conversation), level (light edges above it) and head (the depth of its first node)."""
    ends = tree.where("n_children = 0").select("conv_id", F.col("depth").alias("held"), F.lit(True).alias("ends"))
    # those conversations end where their path does, so that all their turns lie above it
    chains = attach(rows.select("conv_id", *NODE), ends, "conv_id").where("ends").drop("ends")
    chains = attach(chains, tree.where("depth > 0").select(*NODE, "light", F.col("n_convs").alias("held")), *NODE)
    found = chains.groupBy("conv_id").agg(F.sum(F.col("light").cast("long")).alias("level"), F.max(F.when(F.col("light"), F.col("depth"))).alias("head"))
    found = ends.drop("ends").join(found, "conv_id", "left").select("conv_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("head", F.lit(0)).alias("head"), "held")
    found = cut(found)
    on = attach(chains.drop("light"), found, "conv_id").where("depth >= head").select(*NODE, F.col("conv_id").alias("path"), "level", "head")
    none = F.lit(0).cast("long")
    root = found.where("head = 0").select(*[none.alias(c) for c in NODE], F.col("conv_id").alias("path"), "level", "head")
    return tree.join(on.unionByName(root), NODE)


def _summed(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows with each value summed from its path's end up to it, by segments of BLOCK nodes."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    upto = Window.partitionBy("path", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("*", *[F.sum(v).over(upto).alias(f"_{v}") for v in values])
    whole = rows.groupBy("path", "block").agg(*[F.sum(v).alias(v) for v in values])
    below = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK nodes
    carried = whole.select("path", "block", *[F.sum(v).over(below).alias(f"from_{v}") for v in values])
    met = inside.join(carried, ["path", "block"])
    return met.select(*[c for c in rows.columns if c not in (*values, "block")], *[(F.col(f"_{v}") + F.coalesce(f"from_{v}", F.lit(0))).alias(v) for v in values])


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """paths() with each value summed over a node's subtree, one round for each number of light edges."""
    levels = tree.agg(F.max("level")).first()[0]
    done, gifts = None, None
    for level in range(-1 if levels is None else levels, -1, -1):
        now = tree.where(F.col("level") == level)
        if gifts is not None:
            now = now.join(gifts, NODE, "left").select(*[c for c in now.columns if c not in values], *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        now = cut(_summed(now, values))
        done = now if done is None else done.unionByName(now)
        heads = now.where("depth = head").groupBy(*PARENT).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        gifts = heads.toDF(*NODE, *[f"more_{v}" for v in values])
    return tree if done is None else done


_BLOCKS = "depth long, a long, b long, from_id long, ids string"
_HASHED = "depth long, a long, b long, ends_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to IDS numbers in a row of a node that follow one another, joined by commas."""
    key, held, out = None, [], []

    def flush() -> None:
        if held:
            out.append((*key, held[0], ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        for *node, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if node != key or len(held) == IDS:
                flush()
                key = node
            held.append(conv_id)
        if len(out) >= IDS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "from_id", "ids"])
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "from_id", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined blocks, read one after another."""
    key, state, out = None, None, []
    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if node != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= IDS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
            out.clear()
    if key:
        out.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: SHA-256 of the numbers of the conversations that end at a node, ascending, joined by commas.

    Ranges of (node, conv_id) are joined to blocks first; the task that hashes a node reads a row for up to IDS numbers."""
    n = partitions(ends.sparkSession)
    blocks = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined, _BLOCKS)
    return blocks.repartition(n, *NODE).sortWithinPartitions(*NODE, "from_id").mapInArrow(_hashed, _HASHED)


def trie(conversations: DataFrame, span: int = 5, most: int = 8) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    rows, every = rebuilt(conversations, span, most)
    rows = cut(beginnings(rows))
    tree = cut(linked(cut(nodes(rows, every))))
    own = paths(tree, rows).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    sums = subtree_sums(cut(own), ["n_leaves", "saved_tokens"])
    none = F.lit(0).cast("long")
    ends = rows.where("last").select(*NODE, "conv_id").unionByName(every.where("size = 0").select(*[none.alias(c) for c in NODE], "conv_id"))
    found = sums.join(end_digests(ends), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

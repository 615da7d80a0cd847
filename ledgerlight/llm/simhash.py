"""SimHash near-duplicates through an embedding of segment bit counts and a grid join.

A fingerprint of 64 bits becomes 32 counts, one for each pair of bits (0, 1 or 2), kept as a thermometer code: the
Manhattan distance of two embeddings is the bit count of their codes' xor, and never more than the fingerprints'
Hamming distance. The grid: the codes fall into 8 groups of 4 counts. Fingerprints at most 4 bits apart differ in at
most 4 groups, so they share the cell of some 4 groups, of which there are 70. Pairs of a cell pass the lower bound,
then the exact distance, and only in the first cell that they share, all as one join condition.

Documents of equal fingerprints are one node, however many they are. Null and empty texts have fingerprint zero.
Rows without a doc_id take no part; repeated ids are documents of one node each time. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

BITS = 4
GROUPS = 8
SHINGLE = 4
SEED = 42
SALTS = 4
FEW = 1 << 20  # edges that one task joins


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - n + 1)


def fingerprint(text: str | None) -> int:
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if over half the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.fromiter(map(fingerprint, batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": bits.view(np.int64)})

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInPandas(each, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Thermometer codes of the 32 counts: in each pair of bits the low bit says 1 or 2, the high bit says 2."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _group_mask(groups: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * g) for g in groups)
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: pairs of different fingerprints (a < b) that differ in at most bits bits, each once."""
    cells = list(combinations(range(GROUPS), GROUPS - bits))
    masks = F.array(*[F.lit(_group_mask(c)) for c in cells])
    spread = nodes.select("fp", F.posexplode(masks).alias("cell", "mask")).select(
        "cell", embedding(F.col("fp")).bitwiseAND(F.col("mask")).alias("at"), "fp"
    )
    # both sides are the same but for names, so that one exchange serves both
    a, b = spread.toDF("cell_a", "at_a", "a"), spread.toDF("cell_b", "at_b", "b")
    apart = embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))
    # of the groups without a difference, the lowest make the first cell: none outside the cell may lie below its last
    same = [F.when(apart.bitwiseAND(F.lit(_group_mask((g,)))) == 0, F.lit(1 << g)).otherwise(F.lit(0)) for g in range(GROUPS)]
    agreeing = same[0]
    for s in same[1:]:
        agreeing = agreeing.bitwiseOR(s)
    members = F.array(*[F.lit(sum(1 << g for g in c)) for c in cells])
    below = F.array(*[F.lit((1 << (c[-1] + 1)) - 1) for c in cells])
    nth = F.col("cell_a") + 1
    first = agreeing.bitwiseAND(F.element_at(below, nth)) == F.element_at(members, nth)
    lower = F.bit_count(apart) <= bits
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    on = (F.col("cell_a") == F.col("cell_b")) & (F.col("at_a") == F.col("at_b")) & (F.col("a") < F.col("b")) & lower & exact & first
    # Spark sizes the copies like the fingerprints that they come from, so it would broadcast a side 70 times as large as it takes it for
    return a.join(b.hint("merge"), on).select("a", "b")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (to := up.get(x, x)) != x:
            up[x] = x = up.get(to, to)
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            up[max(a, b)] = up[min(a, b)] = min(a, b)
    out = [(x, r) for x in list(up) if (r := find(x)) != x]
    for at in range(0, len(out), 1 << 16):
        yield pd.DataFrame(out[at : at + (1 << 16)], columns=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for other nodes with an edge. Up to FEW edges, some 16 MB, meet in one task;
    beyond that large star and small star, by turns.

    Each turn keeps the components and at least halves the height of the trees, so the turns grow with the logarithm
    of a component's diameter. Edges are pre-aggregated to a node's smallest neighbour before they meet.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= FEW:
        return edges.repartition(1).mapInPandas(_joined, "node long, root long")
    count = -1
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nexts = cut(small.where("u != v").distinct())
        left = nexts.exceptAll(edges).limit(1).count()
        size = nexts.count()
        if left == 0 and size == count:
            return nexts.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, count = nexts, size


def near_duplicates(documents: DataFrame, bits: int = BITS, **columns) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable by links)."""
    docs = cut(fingerprints(documents, **columns))
    # one node for equal fingerprints; its name is its smallest document's
    nodes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = nodes.select("fp", "first")
    pairs = links(nodes, bits)
    pairs = pairs.join(named.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    pairs = pairs.join(named.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").where("x != y")
    roots = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = nodes.join(roots, nodes["first"] == roots["node"], "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    # a fingerprint may stand for a third of all documents: its rows are dealt over several salts
    salted = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return docs.join(salted, ["fp", "_salt"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns; rows without a doc_id stay.

    Of the texts of a repeated id, all stay if one of them is the smallest of its component."""
    kept = near_duplicates(documents, bits).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("row_id"))
    return rows.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").select("row.*").unionByName(documents.where("doc_id is null"))

"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, each pair found.

Fingerprints come first: pairs of SimHash fingerprints at most BITS bits apart (simhash.py, here over five words) are
compared by their sets, and what proves alike becomes one component. At a similarity of 0.8 fingerprints lie some 10 bits
apart and up to 17, too wide for any grid, so a prefix join finds the rest: in any order of all shingles, two sets of that
similarity share one of their first n - ceil(0.8 n) + 1 shingles. The order is that of the hashes, with the shingles that a
sample of the documents has often put last, the most frequent at the very end; it decides only how many pairs are compared.

Sets that share such a shingle are a group. In a group, a pair is compared by its sets only if sizes allow the similarity,
if the two are not yet in one component, and if their bitmaps differ in few bits: a bitmap holds the parity of a set's
shingles in each of 1024 classes, so that two sets differ in at least as many shingles as their bitmaps in bits. First each
set meets its NEAREST likeliest partners of a group, which makes a component of a large group of near copies; then groups
with more possible pairs meet again, for every pair that still lies in two components. So no link is lost, and a large group
takes no square of its size in rows. Large groups are dealt to several tasks.

Equal sets are one node, however many documents have them, and are told apart by 128 bits; texts without a word have the empty set. Rows without a doc_id
are near copies of none. Repeated ids stand for all their texts. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, partitions, release
from .simhash import BITS, components, fingerprint_of, links, shingle_hashes

SHINGLE = 5
SAMPLED = 16  # one in so many documents says which shingles are common
OFTEN = 3  # times in the sample
COMMON = 500_000  # so many of the commonest at most are put last
CLASSES = 1024  # of a bitmap
NEAREST = 8  # partners of a set in a group that are compared first
SLICE = 2048  # sets of a group that one task compares with the whole group
ROWS = 512  # sets sent together
HELD = 1 << 20  # shingles of prefixes that are sent together
FAMILY = 1 << 14  # sets that pairs may connect and that are compared in one task
FEW = 1 << 18  # ids, of 16 bytes at most, up to which they go to every task, by way of the driver


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE)).view(np.int64)


def set_key(shingles: np.ndarray, odd: frozenset[int] = frozenset(), seed: int = 1) -> int:
    """A set's name in 64 bits; another where different sets bear the first one (odd)."""
    key = int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed)).view(np.int64))
    return set_key(shingles, seed=2) if key in odd else key


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each class."""
    return np.packbits(np.bincount(shingles & (CLASSES - 1), minlength=CLASSES) & 1).tobytes()


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The shingles of which a set at least 0.8 alike must share one. common: sorted, put last in the order, by counts."""
    n = len(shingles)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.ones(len(common), np.int64) if counts is None else counts
        shingles = shingles[np.argsort(np.where(common[at] == shingles, weight[at], 0), kind="stable")]
    return shingles[: n - (4 * n + 4) // 5 + 1] if n else shingles


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that the sample has often, sorted, and how often."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.int64), *map(shingle_set, batch["text"])])})

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInPandas(each, "token long")
    often = sample.groupBy("token").count().where(F.col("count") >= OFTEN)
    top = often.orderBy(F.col("count").desc(), "token").limit(COMMON)
    got = top.toArrow()  # COMMON rows at most
    token, count = (got.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(token)
    return token[order], count[order]


def _features(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, fp, key and second (of the set), n (its size), bits (its bitmap), tokens (its prefix)."""
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, out = batch.iloc[at : at + ROWS], []
                for doc_id, text in zip(part["doc_id"].tolist(), part["text"], strict=True):
                    hashes = shingle_hashes(text, SHINGLE)
                    shingles = np.unique(hashes).view(np.int64)
                    fp = int(np.uint64(fingerprint_of(hashes)).view(np.int64))
                    out.append((doc_id, fp, set_key(shingles), set_key(shingles, seed=2), len(shingles), bitmap(shingles), prefix(shingles, *sent.value).tobytes()))
                yield pd.DataFrame(out, columns=["doc_id", "fp", "key", "second", "n", "bits", "tokens"])
        release()

    return rows.mapInPandas(each, "doc_id long, fp long, key long, second long, n int, bits binary, tokens binary")


def _groups(nodes: DataFrame) -> DataFrame:
    """g, slices, key: the sets (by key) that share a shingle of their prefixes, equal groups under one g."""
    parts = max(1, partitions(nodes.sparkSession))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(map(len, batch["tokens"])) // 8
            if size >= HELD:
                yield dealt(pd.concat(held))
                held, size = [], 0
        if held:
            yield dealt(pd.concat(held))
        release()

    def dealt(batch: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint64)
        keys = np.repeat(batch["key"].to_numpy(np.int64), [len(t) // 8 for t in batch["tokens"]])
        # parts by the high half; in a part the low half stands for the shingle: an equal one may join a group, no harm
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        low, keys = tokens[order].astype(np.uint32), keys[order]
        here = [p for p in range(parts) if ends[p] < ends[p + 1]]
        return pd.DataFrame({
            "part": np.array(here, np.int32), "tokens": [low[ends[p] : ends[p + 1]].tobytes() for p in here], "keys": [keys[ends[p] : ends[p + 1]].tobytes() for p in here],
        })

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)  # a part's tokens: 12 bytes for each shingle of a prefix
        tokens = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(t, np.uint32) for b in rows for t in b["tokens"])])
        keys = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(k, np.int64) for b in rows for k in b["keys"])])
        if not len(tokens):
            return
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        ends = np.append(first[1:], len(tokens))
        seen: dict[int, tuple[int, int]] = {}
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            if b - a > 1 and keys[a] != keys[b - 1]:
                seen.setdefault(xxhash.xxh64_intdigest(keys[a:b].tobytes()), (a, b))
        for at in range(0, len(seen), 4096):
            some = list(seen.items())[at : at + 4096]
            sizes = np.array([b - a for _, (a, b) in some])
            yield pd.DataFrame({
                "g": np.repeat(np.array([g for g, _ in some], np.uint64).view(np.int64), sizes), "slices": np.repeat(-(-sizes // SLICE), sizes).astype(np.int32),
                "key": np.concatenate([keys[a:b] for _, (a, b) in some]),
            })

    sent = nodes.select("key", "tokens").mapInPandas(send, "part int, tokens binary, keys binary")
    return sent.repartitionById(parts, "part").mapInPandas(meet, "g long, slices int, key long")


def _compare(size: np.ndarray, bits: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of their shingles the pairs of i and j (all of them) differ in at least, as a share; 1 where they cannot be alike."""
    total = size[i][:, None] + size[j][None, :]
    fits = (5 * np.minimum(size[i][:, None], size[j][None, :]) >= 4 * np.maximum(size[i][:, None], size[j][None, :])) & (root[i][:, None] != root[j][None, :])
    differ = np.zeros(total.shape, np.int64)
    for w in range(bits.shape[1]):
        differ += np.bitwise_count(bits[i, w][:, None] ^ bits[j, w][None, :])
    return np.where(fits & (9 * differ <= total), differ / np.maximum(total, 1), 1.0)


def candidates(key: np.ndarray, size: np.ndarray, bits: np.ndarray, root: np.ndarray, part: int, slices: int, nearest: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of keys of a group that may be alike (the smaller, the greater), and whether there are more: for each set of the
    slice its nearest partners, or without a limit every one of a greater key. Sets come in ascending order of keys, each once."""
    if len(key) < 2 or (root == root[0]).all():
        return key[:0], key[:0], False
    first, second, more = [], [], False
    mine, every = np.arange(part, len(key), slices), np.arange(len(key))
    step = max(1, (1 << 18) // max(1, len(key)))
    for at in range(0, len(mine), step):
        i = mine[at : at + step]
        share = _compare(size, bits, root, i, every)
        if nearest is None or len(key) <= nearest:
            a, b = np.nonzero((share < 1) & (every[None, :] > i[:, None]))
            first.append(key[i[a]])
            second.append(key[b])
            continue
        more |= bool(((share < 1).sum(1) > nearest).any())
        best = np.argpartition(share, nearest - 1, axis=1)[:, :nearest]
        a, c = np.nonzero(np.take_along_axis(share, best, 1) < 1)
        x, y = key[i[a]], key[best[a, c]]
        first.append(np.minimum(x, y))
        second.append(np.maximum(x, y))
    return np.concatenate(first), np.concatenate(second), more


def _proposed(groups: DataFrame, nodes: DataFrame, roots: DataFrame, nearest: int | None) -> DataFrame:
    """a, b: pairs of a group that may be alike; and with nearest, rows of g alone for groups that have more."""
    rows = groups.join(nodes.select("key", "n", "bits"), "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    rows = rows.select("g", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "key", "n", "bits", F.coalesce("root", "key").alias("root"))
    words = CLASSES // 64

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        kept: list[np.ndarray] = []

        def arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            bits = np.frombuffer(b"".join(batch["bits"]), np.uint64).reshape(len(batch), words)
            return batch[["g", "slice", "slices", "key", "n", "root"]].to_numpy(np.int64), bits

        def met(rows: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            firsts, seconds, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                key, at = np.unique(rows[a:b, 3], return_index=True)
                at += a
                x, y, more = candidates(key, rows[at, 4], bits[at], rows[at, 5], int(rows[a, 1]), int(rows[a, 2]), nearest)
                firsts.append(x)
                seconds.append(y)
                full += [int(rows[a, 0])] * more
            return np.concatenate(firsts), np.concatenate(seconds), full

        def shown(rows: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
            a, b, full = met(rows, bits)
            pairs = pd.DataFrame({"g": pd.array([None] * len(a), "Int64"), "a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")}).drop_duplicates()
            return pd.concat([pairs, pd.DataFrame({"g": full, "a": [None] * len(full), "b": [None] * len(full)}, dtype="Int64")])

        for batch in batches:
            rows, bits = arrays(batch)
            rows, bits = np.concatenate([*held, rows]), np.concatenate([*kept, bits])
            last = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            at = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held, kept = [rows[at:]], [bits[at:]]
            if at:
                yield shown(rows[:at], bits[:at])
        if held:
            yield shown(held[0], kept[0])
        release()

    dealt = rows.repartition(max(1, partitions(rows.sparkSession)), "g", "slice").sortWithinPartitions("g", "slice")
    return dealt.mapInPandas(each, "g long, a long, b long")


def _only(rows: DataFrame, keys: DataFrame, name: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows whose name is among keys (or with left_anti is not); few keys go to every task, so that rows stay where they are."""
    keys = cut(keys)
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, name, how)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * shared >= 4 * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, odd: frozenset[int] = frozenset()) -> DataFrame:
    """Edges a, b that connect what the pairs of keys with a similarity of 0.8 or more connect.

    What pairs may connect meets in one task, each set once, and a pair is compared unless others have connected it; where
    that is more than FAMILY sets, sets meet pair by pair.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                sets = [shingle_set(t) for t in batch["text"].iloc[at : at + ROWS]]
                yield pd.DataFrame({"key": [set_key(s, odd) for s in sets], "shingles": [s.tobytes() for s in sets]})
        release()

    def meet(sets: pa.Table, some: pa.Table) -> pa.Table:
        held = {}  # views of Arrow's own memory
        for part in sets.to_batches():
            shingles = part.column("shingles")
            ends = np.frombuffer(shingles.buffers()[1], np.int64 if pa.types.is_large_binary(shingles.type) else np.int32)[shingles.offset : shingles.offset + len(part) + 1].tolist()
            data = np.frombuffer(shingles.buffers()[2] or b"", np.uint8)
            held.update((k, data[a:b].view(np.int64)) for k, a, b in zip(part.column("key").to_pylist(), ends[:-1], ends[1:], strict=True))
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = root.get(up, up)
                k = up
            return k

        out: tuple[list[int], list[int]] = ([], [])
        for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y and _alike(held[a], held[b]):
                root[max(x, y)] = min(x, y)
                out[0].append(a)
                out[1].append(b)
        held.clear()
        release()
        return pa.table([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    pairs = cut(pairs.distinct())
    families = components(pairs)
    sizes = families.groupBy("root").agg((F.count("*") + 1).alias("sets"))
    home = families.select("node", "root").union(families.select("root", "root").distinct())
    home = cut(home.join(sizes, "root").select(F.col("node").alias("key"), "root", "sets"))
    firsts = nodes.select("key", F.col("first").alias("doc_id")).join(home.select("key"), "key").select("doc_id").distinct()
    # a repeated id may bring other texts along: their keys join with nothing
    sets = _only(rows, firsts, "doc_id").mapInPandas(each, "key long, shingles binary").join(home, "key")
    parts = max(1, partitions(rows.sparkSession))
    bucket = F.pmod(F.xxhash64("root"), F.lit(4 * parts)).cast("int").alias("bucket")
    asked = pairs.join(home.withColumnRenamed("key", "a"), "a")
    small = sets.where(F.col("sets") <= FAMILY).select(bucket, "key", "shingles")
    met = small.groupBy("bucket").cogroup(asked.where(F.col("sets") <= FAMILY).select(bucket, "a", "b").groupBy("bucket")).applyInArrow(meet, "a long, b long")
    if not sizes.where(F.col("sets") > FAMILY).limit(1).count():
        return met
    large = sets.where(F.col("sets") > FAMILY).dropDuplicates(["key"]).select("key", "shingles")
    both = asked.where(F.col("sets") > FAMILY).select("a", "b").join(large.toDF("a", "x"), "a").join(large.toDF("b", "y"), "b")
    return met.union(both.select("a", "b", "x", "y").mapInPandas(alike, "a long, b long"))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs of keys, those that sizes and bitmaps allow."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in ("x", "y"))
            n, m = (b[c].to_numpy(np.int64) for c in ("n", "m"))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield b.loc[(5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * differ <= n + m), ["a", "b"]]

    both = pairs.join(nodes.select(F.col("key").alias("a"), "n", F.col("bits").alias("x")), "a").join(nodes.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInPandas(each, "a long, b long")


def near_copies(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by pairs of near copies)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    docs = cut(_features(rows, _common(rows)))
    named = cut(docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("second").alias("low"), F.max("second").alias("high")))
    # names that different sets bear: of n sets some n^2 / 2^65
    odd = frozenset(r["key"] for r in named.where("low != high").select("key").collect())
    if odd:
        docs = docs.withColumn("key", F.when(F.col("key").isin(list(odd)), F.col("second")).otherwise(F.col("key")))
        named = cut(docs.groupBy("key").agg(F.min("doc_id").alias("first")))
    # a node for each set: the rows that repeat one are left out, and of rows alike in doc_id and set all but one
    spare = docs.select("doc_id", "key").join(named, "key").where("doc_id != first").select("doc_id", "key")
    twice = docs.groupBy("doc_id", "key").count().where("count > 1")
    nodes = _only(docs, spare.distinct(), ["doc_id", "key"], "left_anti").withColumn("first", F.col("doc_id"))
    if twice.limit(1).count():
        nodes = nodes.dropDuplicates(["key"])
    nodes = nodes.select("key", "first", "fp", "n", "bits", "tokens")
    # fingerprints: different sets of one fingerprint are linked in a chain, near fingerprints by their smallest sets
    by_fp = nodes.groupBy("fp").agg(F.min("key").alias("least"))
    same = nodes.join(by_fp, "fp").where("key != least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    near = links(by_fp.select("fp"), bits)
    near = near.join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges = cut(verified(_possible(same.union(near), nodes), rows, nodes, odd))
    roots = components(edges)

    # shared shingles
    groups = cut(_groups(nodes))
    found = cut(_proposed(groups, nodes, roots, NEAREST))
    edges = cut(edges.union(verified(found.where("g is null").select("a", "b"), rows, nodes, odd)))
    roots = components(edges)
    more = groups.join(found.where("g is not null").select("g").distinct(), "g", "left_semi")
    rest = _proposed(more, nodes, roots, None).select("a", "b")
    roots = components(edges.union(verified(rest, rows, nodes, odd)))

    firsts = named.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.select("doc_id", "key").join(firsts.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns; rows without a doc_id stay.

    Of the texts of a repeated id, all stay if one of them is the smallest of its component."""
    kept = near_copies(documents).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("row_id"))
    return rows.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").select("row.*").unionByName(documents.where("doc_id is null"))

"""Token ids in a content-addressed store.

A rolling hash over the last WINDOW ids cuts each document's ids into chunks, so that equal passages give equal
chunks. A chunk is named by its BLAKE2b digest and stored once. A recipe lists a document's chunks. Chunks are dealt to
parts by name, recipes by ranges of doc_id, in ascending order; both lie in a part's file, written in one pass, with two
lines of the manifest: how many chunks and recipes the part has, how many ids its documents have, and the roots of the
Merkle trees over both.

    <store>/items  kind=chunk:    part, name (digest), data (a byte for the width, then ids as little-endian integers of 16 or 32 bits)
                   kind=recipe:   part, doc_id, start (ids before it in its part), n_tokens, name (digests, joined)
                   kind=manifest: part, data (of what), start (items), n_tokens, name (root)
    <store>/root   lines (of the manifest), n_tokens (of all documents), root (of the tree over the lines)

The root over all lines is written last, in a file of its own: without it there is no store, and a lost file, whose lines are
lost with it, does not go unnoticed. read() holds the files against the manifest and its root and raises an error where they differ, decodes every chunk, checks it against
its name, and puts documents' checksums together from their chunks' (CRC-32 of joined strings follows from those of the
parts and their lengths).

Null text: an empty document, its end id alone. Rows without a doc_id come first; a doc_id's several rows are documents
one after another, by their ids. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions, shared_path
from ._tokens import encoder

WINDOW = 16
MASK = (1 << 9) - 1  # a chunk ends after 512 ids on average
LEAST, MOST = 64, 4096
DIGEST = 16
ROWS = 1 << 12  # documents whose chunks are joined before they are sent
BYTES = 1 << 24  # or so many bytes of ids
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of ids end. The rolling hash is a sum over the window of mixed ids, weighted by place."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    x = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(29)
    rolled, width = x, 1
    while width < WINDOW:  # twice the width a time: the older half is rotated
        rolled = rolled[width:] + ((rolled[:-width] << np.uint64(7)) | (rolled[:-width] >> np.uint64(57)))
        width *= 2
    rolled = (rolled * _ODD) >> np.uint64(40)
    ends = np.flatnonzero((rolled & np.uint64(MASK)) == 0) + WINDOW
    out, last = [], 0
    for e in ends.tolist():
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST:
            out.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out + [n] if last < n else out


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root over leaves in their order; an odd one out moves up alone. Empty: the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def _narrow(ids: np.ndarray) -> bytes:
    """A byte for the width, then the ids."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"\2" else "<u4", offset=1).astype("<u4")


_ROWS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("name", pa.binary()), ("data", pa.binary())])
_ITEMS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("name", pa.binary()), ("data", pa.binary())])
_SQL = "kind string, part int, doc_id long, start long, n_tokens long, name binary, data binary"


def _encode(path: str, kind: str, end_id: int, parts: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind, end_id)
        seen: set[bytes] = set()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.many(batch.column("text").to_pylist()), strict=True):
                names, last = [], 0
                raw = _narrow(ids)
                mark, width, raw = raw[:1], raw[0], raw[1:]
                for end in cuts(ids):
                    chunk = mark + raw[width * last : width * end]
                    name = digest(chunk)
                    names.append(name)
                    last = end
                    if name not in seen:
                        seen.add(name)
                        size += len(chunk)
                        rows.append(("chunk", int.from_bytes(name[:7], "little") % parts, None, None, name, chunk))
                to = 0 if doc_id is None else int(np.searchsorted(edges, doc_id, side="right"))
                rows.append(("recipe", to, doc_id, len(ids), b"".join(names), None))
                if size >= BYTES or len(rows) >= ROWS:
                    yield frame(rows)
                    rows, size = [], 0
            if len(seen) > 1 << 20:
                seen = set()
        if rows:
            yield frame(rows)

    return run


def _recipe_leaf(doc_id: int | None, start: int, n_tokens: int, names: bytes) -> bytes:
    return digest(f"{doc_id},{start},{n_tokens},".encode() + names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's rows, chunks by name, then recipes by doc_id: of each chunk the first, each recipe's start, the manifest's lines."""
    last, start, part = None, 0, None
    leaves: dict[str, list[bytes]] = {"chunk": [], "recipe": []}
    for batch in batches:
        keep, starts = [], []
        columns = (batch.column(c).to_pylist() for c in ("kind", "part", "doc_id", "n_tokens", "name"))
        for kind, part, doc_id, n, name in zip(*columns, strict=True):  # noqa: B007
            if kind == "chunk":
                keep.append(name != last)
                starts.append(None)
                if name != last:
                    leaves["chunk"].append(name)
                last = name
            else:
                keep.append(True)
                starts.append(start)
                leaves["recipe"].append(_recipe_leaf(doc_id, start, n, name))
                start += n
        out = [batch.column(c) if c != "start" else pa.array(starts, pa.int64()) for c in _ITEMS.names]
        yield pa.RecordBatch.from_arrays(out, schema=_ITEMS).filter(pa.array(keep))
    if part is not None:
        lines = [("manifest", part, None, len(x), start if k == "recipe" else 0, merkle_root(x), k.encode()) for k, x in leaves.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), _ITEMS.types, strict=True)], schema=_ITEMS)


def write(documents: DataFrame, store: str, tokenizer_path: str, kind: str = "space", end_id: int = 2) -> None:
    parts = partitions(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [i / parts for i in range(1, parts)]
    bounds = (docs.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0] or []) if shares else []
    rows = docs.mapInArrow(_encode(tokenizer_path, kind, end_id, parts, bounds), "kind string, part int, doc_id long, n_tokens long, name binary, data binary")
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("kind", "doc_id", "name").mapInArrow(_pack, _SQL)
    rows.write.option("compression", "zstd").parquet(f"{store}/items")
    spark = documents.sparkSession
    spark.createDataFrame([_root(spark, store)], _ROOT).coalesce(1).write.parquet(f"{store}/root")


_ROOT = "lines long, n_tokens long, root binary"


def _root(spark: SparkSession, store: str) -> tuple[int, int, bytes]:
    """What the root's file has to say of the manifest's lines, of which each part has two."""
    lines = sorted((r["of"], r["part"], r["items"], r["n_tokens"], bytes(r["root"])) for r in _lines(spark, store).collect())
    return len(lines), sum(r[3] for r in lines), merkle_root([f"{of},{part},{items},{n},".encode() + root for of, part, items, n, root in lines])


def _items(spark: SparkSession, store: str, kind: str) -> DataFrame:
    return spark.read.schema(_SQL).parquet(f"{store}/items").where(F.col("kind") == kind).drop("kind")


def _chunks(spark: SparkSession, store: str) -> DataFrame:
    return _items(spark, store, "chunk").select("name", "data")


def _lines(spark: SparkSession, store: str) -> DataFrame:
    """of, part, items, n_tokens, root: what the manifest says."""
    return _items(spark, store, "manifest").select(F.col("data").cast("string").alias("of"), "part", F.col("start").alias("items"), "n_tokens", F.col("name").alias("root"))


def verify(spark: SparkSession, store: str) -> DataFrame:
    """The manifest's lines that the files do not bear out, and parts without a line; none if all is well."""

    def root(key: tuple, group: pa.Table) -> pa.Table:
        kind, part = (k.as_py() for k in key)
        if kind == "chunk":
            leaves, total = sorted(group.column("name").to_pylist()), 0
        else:
            rows = sorted(zip(*(group.column(c).to_pylist() for c in ("start", "doc_id", "n_tokens", "name")), strict=True), key=lambda r: r[0])
            leaves, total = [_recipe_leaf(d, s, n, x) for s, d, n, x in rows], sum(r[2] for r in rows)
        line = {"of": [kind], "part": [part], "items": [len(leaves)], "n_tokens": [total], "root": [merkle_root(leaves)]}
        return pa.table(line, pa.schema([("of", pa.string()), ("part", pa.int32()), ("items", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    # a part's leaves are 16 bytes a chunk, and its recipes
    items = spark.read.schema(_SQL).parquet(f"{store}/items").where("kind != 'manifest'").select(F.col("kind").alias("of"), "part", "doc_id", "start", "n_tokens", "name")
    found = items.groupBy("of", "part").applyInArrow(root, "of string, part int, items long, n_tokens long, root binary")
    said = _lines(spark, store)
    empty = (F.col("items") == 0) & (F.col("root") == F.lit(merkle_root([])))
    both = found.select("*", F.lit(1).alias("n")).union(said.where(~empty).select("*", F.lit(-1)))
    return both.groupBy("of", "part", "items", "n_tokens", "root").agg(F.sum("n").alias("n")).where("n != 0").drop("n")


# ---- CRC-32 of joined strings -----------------------------------------------------------------------------------


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(maxsize=1 << 14)
def _zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes do to a CRC-32, as a matrix over bits."""
    if n == 0:
        return tuple(1 << i for i in range(32))
    if n == 1:
        table = []
        for i in range(32):
            c = 1 << i
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            table.append(c)
        return tuple(table)
    half = _zeros(n // 2)
    twice = tuple(_times(half, x) for x in half)
    return tuple(_times(_zeros(1), x) for x in twice) if n % 2 else twice


def crc_join(first: int, second: int, second_length: int) -> int:
    return _times(_zeros(second_length), first) ^ second


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, crc, n: from every chunk's bytes, which must bear its name."""
    for batch in batches:
        crc, n = [], []
        for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if digest(data) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            raw = _wide(data).tobytes()
            crc.append(zlib.crc32(raw))
            n.append(len(raw) // 4)
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], ["name", "crc", "n"])


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's files; an error where the manifest differs."""
    said = [(r["lines"], r["n_tokens"], bytes(r["root"])) for r in spark.read.schema(_ROOT).parquet(f"{store}/root").limit(2).collect()]
    if said != [_root(spark, store)]:
        raise ValueError("the store's root does not describe its manifest: files are lost, or of another store")
    if wrong := verify(spark, store).limit(3).collect():
        raise ValueError(f"the manifest does not describe the store: {wrong}")
    chunks = _chunks(spark, store).mapInArrow(_checked, "name binary, crc long, n long")
    recipes = _items(spark, store, "recipe").select("part", "doc_id", "start", "n_tokens", F.col("name").alias("names"))
    places = F.sequence(F.lit(0), F.floor(F.length("names") / DIGEST).cast("int") - 1)
    refs = recipes.where("n_tokens > 0").select("part", "doc_id", "start", "n_tokens", "names", F.explode(places).alias("nth"))
    refs = refs.withColumn("name", F.expr(f"substring(names, nth * {DIGEST} + 1, {DIGEST})")).drop("names")
    parts = refs.join(chunks, "name", "left")  # AQE splits a chunk that very many documents hold

    def joined(pieces: list[dict]) -> int:
        crc, n = 0, 0
        for p in sorted(pieces, key=lambda p: p["nth"]):
            if p["crc"] is None or p["n"] is None:
                raise ValueError("a recipe names a chunk that the store lacks")
            crc = crc_join(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
            n += p["n"]
        return crc if n else 0

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column("pieces").to_pylist()
            if [sum(x["n"] for x in p if x["n"] is not None) for p in pieces] != b.column("n_tokens").to_pylist():
                raise ValueError("a document's chunks do not make its number of ids")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(map(joined, pieces), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    grouped = parts.groupBy("part", "start", "doc_id", "n_tokens").agg(F.collect_list(F.struct("nth", "crc", "n")).alias("pieces"))
    # a line for each part: the ids of the parts before it
    before = _lines(spark, store).where("of = 'recipe'").select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    placed = grouped.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "pieces")
    return placed.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, store: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents, put together from their chunks (a round trip for tests and spot checks)."""
    listed = _items(spark, store, "recipe").where(F.col("doc_id").isin(doc_ids)).collect()
    names = {r["name"][i : i + DIGEST] for r in listed for i in range(0, len(r["name"]), DIGEST)}
    got = {bytes(r["name"]): bytes(r["data"]) for r in _chunks(spark, store).where(F.col("name").isin([bytearray(n) for n in names])).collect()}
    return {
        r["doc_id"]: [x for i in range(0, len(r["name"]), DIGEST) for x in _wide(got[bytes(r["name"][i : i + DIGEST])]).tolist()]
        for r in listed
    }


def round_trip(documents: DataFrame, tokenizer_path: str, kind: str = "space", end_id: int = 2, store: str | None = None) -> DataFrame:
    """Writes documents to a store (in the shared folder unless named) and gives what read() finds there."""
    spark = documents.sparkSession
    store = store or shared_path(spark, "token-store")
    write(documents, store, tokenizer_path, kind, end_id)
    return read(spark, store)

"""Shards and slots by a Feistel permutation of global row numbers.

Documents in ascending doc_id order have row numbers 0 to n-1. A balanced Feistel network over the least even number
of bits that holds n permutes the numbers up to a power of four; a number that falls outside 0..n-1 is walked on along
its cycle until it falls inside, which makes a permutation of exactly n numbers. Number p goes to shard p mod k, slot
p // k: shards' counts differ by one at most, slots have no gaps, and both follow from n, the seed and the row number
alone, as does the way back. Law: rows.

Null text: size 8, the checksum of nothing. Rows without a doc_id come first and are dealt like others; rows that
repeat a doc_id come one after another, by text checksum. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import number_rows

ROUNDS = 6
SHARDS = 24


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(29)) & mask


def _keys(seed: int) -> list[int]:
    return [(seed * 0x2545F4914F6CDD1D + r * 0x632BE59BD9B4E019 + 1) & (2**64 - 1) for r in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    h = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(h)) - 1)
    left, right = x >> h, x & mask
    for key in reversed(_keys(seed)) if back else _keys(seed):
        if back:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return (left << h) | right


def permute(rows: np.ndarray, n: int, seed: int = 11, back: bool = False) -> np.ndarray:
    """The places of row numbers 0..n-1 in the shuffle, or with back the row numbers of places."""
    out = np.asarray(rows).astype(np.uint64)
    out = _network(out, n, seed, back) if len(out) else out
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], n, seed, back)
    return out.astype(np.int64)


def shard(documents: DataFrame, shards: int = SHARDS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are read once and never moved."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = number_rows(rows, "doc_id", "text_crc32", "size")
    n = rows.count()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = permute(b["row_number"].to_numpy(), n, seed)
            b["law"], b["shard"], b["slot"] = "rows", p % shards, p // shards
            yield b[["doc_id", "size", "text_crc32", "law", "shard", "slot"]]

    out = rows.mapInPandas(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long")
    return out.withColumn("grown_shard", F.lit(None).cast("int"))

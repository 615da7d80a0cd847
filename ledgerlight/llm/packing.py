"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens at once.

The documents of a task are packed as they come, WINDOW ids at a time, in the task that encodes them; no text or id is
shuffled. An item is a vector of its tokens, its one segment and its loss-bearing tokens, as shares of the limits. A
sequence begins with the largest item left and then takes, of those that fit whole, the one whose vector has the largest dot
product with the sequence's free space, until none fits; items of equal vectors, a few thousand kinds at most, are held together,
so that a step costs by kinds and a window by its ids. A document longer than a sequence is cut: its full lengths are
sequences of their own, the rest is an item. When a window ends, gaps that are left are filled from the least filled
sequences, whose pieces are cut to fit; the sequence for which no pieces remain is split into powers of two, which need no
padding. A sequence that can take no more segments keeps as many pieces as make a power of two. With whole, for instruction data, nothing that fits a sequence is cut: gaps stay.

For plain documents every token bears loss; for instruction data loss_col names the number of a row's last tokens
that do. Null text: the end id alone. Rows without a doc_id are packed like others; repeated rows each for itself.
An empty table gives an empty result. Which documents share a sequence follows from how the table's files are split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut
from ._tokens import encoder

LENGTH = 4096
SEGMENTS = 512
WINDOW = 1 << 21  # ids packed together

Piece = tuple[int, int, int]  # item, first id, number of ids


def _loss(piece: Piece, first_loss: np.ndarray) -> int:
    item, start, n = piece
    return max(0, start + n - max(start, int(first_loss[item])))


def pack(lengths: np.ndarray, first_loss: np.ndarray, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, whole: bool = False) -> list[list[Piece]]:
    """Sequences of pieces. lengths: ids of each item; first_loss: from which of its ids on they bear loss."""
    done: list[list[Piece]] = []
    rest: list[Piece] = []
    step = min(length, loss)
    for i, n in enumerate(lengths.tolist()):
        at = 0
        if not (whole and n <= length and _loss((i, 0, n), first_loss) <= loss):
            while n - at >= step:
                done.append([(i, at, step)])
                at += step
        if n > at:
            rest.append((i, at, n - at))
    held: dict[tuple[int, int, int], list[Piece]] = {}  # items of equal vectors, of which there are few
    for p in sorted(rest, key=lambda p: -p[0]):
        held.setdefault((p[2], 1, _loss(p, first_loss)), []).append(p)
    order = sorted(held, reverse=True)
    vectors, stacks, limits = np.array(order, np.int64).reshape(-1, 3), [held[v] for v in order], np.array([length, segments, loss])
    while stacks:
        j, free, sequence = int((vectors / limits).max(1).argmax()), limits.copy(), []
        n = 1
        while n:
            sequence += [stacks[j].pop() for _ in range(n)]
            free = free - n * vectors[j]
            if not stacks[j]:
                del stacks[j]
                vectors = np.delete(vectors, j, 0)
            at = int(np.searchsorted(-vectors[:, 0], -free[0]))  # in descending order of tokens
            fits = at + np.flatnonzero((vectors[at:] <= free).all(1))
            n = 0
            if len(fits):
                left = vectors[fits]
                best = int((left @ (free / limits**2)).argmax())
                j, n = int(fits[best]), 1
                if (left[best] == left.max(0)).all():  # largest in every way, it stays the best while it fits
                    n = min(len(stacks[j]), int((free // np.maximum(left[best], 1))[left[best] > 0].min()))
        done.append(sequence)
    return done if whole else _tighten(done, first_loss, length, segments, loss)


def _tighten(done: list[list[Piece]], first_loss: np.ndarray, length: int, segments: int, loss: int) -> list[list[Piece]]:
    """Gaps filled with pieces of the least filled sequences, the last of which is split into powers of two."""
    used = lambda s: sum(p[2] for p in s)
    bearing = lambda s: sum(_loss(p, first_loss) for p in s)
    whole = [s for s in done if used(s) == length]
    part = sorted((s for s in done if used(s) < length), key=used, reverse=True)
    spare: list[Piece] = []
    out: list[list[Piece]] = []
    while part or spare:
        if not part:
            part.append([spare.pop()])
            continue
        s = part.pop(0)
        n, k, b = used(s), len(s), bearing(s)
        last = False
        while n < length and k < segments:
            if not spare:
                if not part:
                    last = True
                    break
                spare = part.pop()
            p = spare.pop()
            take = min(p[2], length - n)
            while take and b + _loss((p[0], p[1], take), first_loss) > loss:
                take -= max(1, b + _loss((p[0], p[1], take), first_loss) - loss)
            take = max(0, take)
            if take < p[2]:
                spare.append((p[0], p[1] + take, p[2] - take))
            if not take:
                break
            s.append((p[0], p[1], take))
            n, k, b = n + take, k + 1, b + _loss((p[0], p[1], take), first_loss)
        if n < length and k == segments and not last:  # full of short pieces: those beyond a power of two are spare again
            want = 1 << (n.bit_length() - 1)
            while n > want:
                i, at, m = s.pop()
                over = min(m, n - want)
                spare.append((i, at + m - over, over))
                if over < m:
                    s.append((i, at, m - over))
                n -= over
        (out if last else whole).append(s)
    for s in out:
        n = used(s)
        s = list(s)[::-1]
        while n:  # the largest power of two that is left
            want, now = 1 << (n.bit_length() - 1), []
            n -= want
            while want:
                i, at, m = s.pop()
                t = min(m, want)
                now.append((i, at, t))
                want -= t
                if t < m:
                    s.append((i, at + t, m - t))
            whole.append(now)
    return whole


def pack_documents(
    documents: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = 2, length: int = LENGTH, segments: int = SEGMENTS,
    loss: int = LENGTH, loss_col: str | None = None, whole: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, part of each piece. Sequences count on from task to task."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]
    kinds = {"doc_id": "Int64"}
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), (F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")).alias("loss")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(tokenizer_path, kind, end_id), TaskContext.get()
        part, count = task.partitionId() if task else 0, 0
        held: list[tuple[int, np.ndarray, int]] = []

        def flush() -> pd.DataFrame:
            nonlocal count
            lengths = np.array([len(x) for _, x, _ in held], np.int64)
            first_loss = np.array([f for _, _, f in held], np.int64)
            out = []
            for sequence in pack(lengths, first_loss, length, segments, loss, whole):
                offset = 0
                for i, at, n in sequence:
                    doc_id, ids, _ = held[i]
                    out.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), count, offset, part))
                    offset += n
                count += 1
            held.clear()
            return pd.DataFrame(out, columns=columns).astype(kinds)

        size = 0
        for batch in batches:
            for doc_id, ids, bearing in zip((None if pd.isna(d) else int(d) for d in batch["doc_id"]), encode.many(batch["text"]), batch["loss"], strict=True):
                first = 0 if bearing is None or bearing != bearing else max(0, len(ids) - int(bearing))
                held.append((doc_id, ids, first))
                size += len(ids)
                if size >= WINDOW:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int"
    pieces = cut(docs.mapInPandas(run, schema))
    counts = pieces.groupBy("part").agg((F.max("sequence_id") + 1).alias("_n"))  # a row for each task
    starts = counts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_start"))
    return pieces.join(F.broadcast(starts), "part").withColumn("sequence_id", F.col("sequence_id") + F.col("_start")).drop("_start")

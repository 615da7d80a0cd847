"""Fill-in-middle: texts cut at two units (lines) into prefix, middle and suffix, and put together in another order.

A deterministic automaton reads bytes; its state says whether a line has begun and how much of a mark has been read. What
a stretch of text does is a function from the state before it to the state after it, with the number of lines that end in it
for each state before it. Such functions compose associatively, so that a text is summed up as a tree over its bytes
(runs of bytes that change nothing are one leaf) and a text of more than CHUNK bytes as a tree over chunks, whose functions
tasks compute without knowing what came before. The tree gives the number of lines, whether a mark occurs and, by descending
into the half that holds a given line end, the place of a cut: first its chunk, its state there and the lines left to
count, then the byte, found in that chunk alone.

A text of up to CHUNK bytes is one chunk and is read where it lies. Longer ones are dealt chunk by chunk; a text has fewer than
2^31 bytes in Spark, so a document has fewer than 2^31 / CHUNK functions. Null text: empty, form plain. Null doc_id: drawn as an
empty number. Repeated rows are cut alike. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, partitions

CHUNK = 1 << 16
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Automaton:
    """classes: of each byte, 0 for those that change nothing twice; step, ends: by state and class; open, found: by state."""

    classes: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    open: np.ndarray  # a line has begun
    found: np.ndarray  # a mark has been read


@lru_cache(maxsize=8)
def automaton(marks: tuple[str, ...] = MARKS) -> Automaton:
    """Lines that end with a line feed, beside the marks, of which none may hold a line feed. State: 2 * (read of a mark) + (line begun)."""
    words = [m.encode() for m in marks]
    if any(b"\n" in w or not w for w in words):
        raise ValueError("marks are not empty and hold no line feed")
    read = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda x: (len(x), x))
    number = {x: i for i, x in enumerate(read)}
    known = sorted({b for w in words for b in w})
    classes = np.zeros(256, np.uint8)
    classes[10] = 1
    for i, b in enumerate(known):
        classes[b] = 2 + i
    states = 2 * (len(read) + 1)
    step, ends = np.zeros((states, 2 + len(known)), np.uint8), np.zeros((states, 2 + len(known)), np.int64)
    for at in range(states):
        for c in range(step.shape[1]):
            if at // 2 == len(read):
                to = len(read)
            elif c < 2:
                to = 0
            else:
                said = read[at // 2] + bytes([known[c - 2]])
                tails = (said[i:] for i in range(len(said) + 1))
                to = len(read) if any(said.endswith(w) for w in words) else next(number[x] for x in tails if x in number)
            step[at, c], ends[at, c] = 2 * to + (c != 1), c == 1
    every = np.arange(states)
    return Automaton(classes, step, ends, every % 2 == 1, every // 2 == len(read))


class Tree:
    """Functions of neighbouring stretches and, level by level, of twice as many."""

    def __init__(self, to: np.ndarray, count: np.ndarray) -> None:
        self.levels = [(to, count)]
        while len(to) > 1:
            odd = len(to) % 2
            a, b, x, y = to[: len(to) - odd : 2], to[1::2], count[: len(to) - odd : 2], count[1::2]
            at = a.astype(np.intp)
            both, sums = np.take_along_axis(b, at, 1), x + np.take_along_axis(y, at, 1)
            to, count = (np.vstack([both, to[-1:]]), np.vstack([sums, count[-1:]])) if odd else (both, sums)
            self.levels.append((to, count))

    @property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        to, count = self.levels[-1]
        return to[0], count[0]

    def select(self, state: int, nth: int) -> tuple[int, int, int]:
        """The stretch in which the nth end (from 1) lies, the state before it, and which of its own ends it is."""
        at = 0
        for to, count in reversed(self.levels[:-1]):
            at *= 2
            if at + 1 < len(to) and nth > count[at, state]:
                nth, state, at = nth - int(count[at, state]), int(to[at, state]), at + 1
        return at, state, nth


def scan(data: np.ndarray, m: Automaton) -> tuple[Tree, np.ndarray]:
    """The tree over data's bytes, and the place of each leaf."""
    classes = m.classes[data]
    keep = classes != 0
    keep[:1] = True
    keep[1:] |= classes[:-1] != 0  # of bytes that change nothing the first in a row
    at = np.flatnonzero(keep)
    kinds = classes[at]
    if not len(at):
        return Tree(np.arange(len(m.step), dtype=np.uint8)[None], np.zeros((1, len(m.step)), np.int64)), at
    return Tree(m.step.T[kinds], m.ends.T[kinds]), at


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _array(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint8)


_CUTS = pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("first", pa.int64()), ("second", pa.int64())])


def _whole(marks: tuple[str, ...]):
    @F.arrow_udf("n long, marked boolean, first long, second long")
    def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        m, out = automaton(marks), []
        for x, *draws in zip(text, one.to_pylist(), two.to_pylist(), strict=True):
            data = _array(x)
            tree, at = scan(data, m)
            to, count = tree.whole
            n = int(count[0]) + int(m.open[to[0]])
            places = [_byte(tree, at, 0, k, n, len(data)) for k in sorted(d % (n + 1) for d in draws)]
            out.append({"n": n, "marked": bool(m.found[to[0]]), "first": (f := characters(data[: places[0]])), "second": f + characters(data[places[0] : places[1]])})
        return pa.array(out, _CUTS)

    return cuts


def _byte(tree: Tree, at: np.ndarray, state: int, nth: int, n: int, size: int) -> int:
    return 0 if nth == 0 else size if nth == n else int(at[tree.select(state, nth)[0]]) + 1


def _function(marks: tuple[str, ...]):
    @F.arrow_udf("to array<int>, ends array<long>, chars long")
    def function(piece: pa.Array) -> pa.Array:
        m, out = automaton(marks), []
        for x in piece:
            data = _array(x)
            to, count = scan(data, m)[0].whole
            out.append({"to": to.tolist(), "ends": count.tolist(), "chars": characters(data)})
        return pa.array(out, pa.struct([("to", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("chars", pa.int64())]))

    return function


_PLACE = "chunk int, state int, nth long, before long"


def _places(marks: tuple[str, ...]):
    @F.arrow_udf(f"n long, marked boolean, first struct<{_PLACE.replace(' ', ':').replace(',:', ',')}>, second struct<{_PLACE.replace(' ', ':').replace(',:', ',')}>")
    def places(chunks: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        m, out = automaton(marks), []
        for pieces, *draws in zip(chunks.to_pylist(), one.to_pylist(), two.to_pylist(), strict=True):
            tree = Tree(np.array([p["to"] for p in pieces], np.uint8), np.array([p["ends"] for p in pieces], np.int64))
            to, count = tree.whole
            before = np.concatenate([[0], np.cumsum([p["chars"] for p in pieces])])
            n = int(count[0]) + int(m.open[to[0]])
            row = {"n": n, "marked": bool(m.found[to[0]])}
            for name, k in zip(("first", "second"), sorted(d % (n + 1) for d in draws), strict=True):
                at, state, nth = tree.select(0, k) if 0 < k < n else (0, 0, 0)
                row[name] = {"chunk": at, "state": state, "nth": nth, "before": int(before[-1] if k == n else before[at])}
            out.append(row)
        place = pa.struct([("chunk", pa.int32()), ("state", pa.int32()), ("nth", pa.int64()), ("before", pa.int64())])
        return pa.array(out, pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("first", place), ("second", place)]))

    return places


def _inside(marks: tuple[str, ...]):
    @F.arrow_udf("long")
    def inside(piece: pa.Array, state: pa.Array, nth: pa.Array) -> pa.Array:
        m, out = automaton(marks), []
        for x, s, k in zip(piece, state.to_pylist(), nth.to_pylist(), strict=True):
            data = _array(x)
            tree, at = scan(data, m) if k else (None, None)
            out.append(characters(data[: int(at[tree.select(s, k)[0]]) + 1]) if k else 0)
        return pa.array(out, pa.int64())

    return inside


def _long(rows: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """rows with n, marked, first, second, from chunks that any task may read."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    piece = lambda i: F.substring(F.col("text").cast("binary"), i * CHUNK + 1, F.lit(CHUNK))
    last = F.floor((F.octet_length("text") - 1) / CHUNK).cast("int")
    pieces = rows.select("doc_id", "digest", F.posexplode(F.transform(F.sequence(F.lit(0), last), piece)).alias("chunk", "piece"))
    pieces = pieces.repartition(partitions(rows.sparkSession), "doc_id", "digest", "chunk")
    chunks = cut(pieces.select("doc_id", "digest", "chunk", _function(marks)("piece").alias("f")))
    # a set: repeated rows have the same functions
    met = chunks.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("chunk", "f.to", "f.ends", "f.chars"))).alias("chunks"))
    found = met.select(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest"), _places(marks)("chunks", *_draws(F.col("doc_id"))[:2]).alias("p"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
    for name in ("first", "second"):
        at = F.col(f"p.{name}")
        rows = rows.withColumn(name, at["before"] + _inside(marks)(piece(at["chunk"]), at["state"], at["nth"]))
    return rows.withColumn("n", F.col("p.n")).withColumn("marked", F.col("p.marked")).drop("digest", "of", "of_digest", "p")


def _draws(doc_id: Column, seed: int = 7) -> list[Column]:
    """Four numbers of 32 bits from the document's number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(form: Column, output: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output of transform() came from."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(output))
        b = F.substring_index(rest, m, 1)
        return a, b, F.substring(rest, F.length(b) + len(m) + 1, F.length(output))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def transform(documents: DataFrame, marks: tuple[str, str, str] = MARKS, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    rate: hundredths of the documents that are transformed; spm: of those, hundredths whose suffix comes first."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    one, two, three, four = _draws(F.col("doc_id"))
    short = rows.where(F.octet_length("text") <= CHUNK).withColumn("cuts", _whole(marks)("text", one, two))
    long = _long(rows.where(F.octet_length("text") > CHUNK), marks)
    every = short.select("doc_id", "text", "cuts.*").unionByName(long)
    plain = (F.col("text") == "") | F.col("marked") | (three % 100 >= rate)
    every = every.withColumn("form", F.when(plain, "plain").when(four % 100 < spm, "spm").otherwise("psm"))
    of = lambda at, n: F.substring("text", at, n)
    first, second, size = F.col("first").cast("int"), F.col("second").cast("int"), F.length("text")
    prefix, middle, suffix = of(F.lit(1), first), of(first + 1, second - first), of(second + 1, size)
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = F.col("form") != "plain"
    return every.select(
        "doc_id", "n", "form", F.when(shown, F.col("first")).alias("prefix_chars"), F.when(shown, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"),
    )

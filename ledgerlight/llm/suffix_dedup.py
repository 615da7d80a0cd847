"""Removing passages that an earlier document holds, by difference-cover suffix sorting.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id. Sorting all suffixes
of all texts as rows would shuffle every text many times over, so the suffixes are dealt out first, in a way that
keeps equal 50-byte strings together and drops no pair of them:

1. Each 50-byte string is named by its minimizer, the least hash among its 31 strings of 20 bytes. Equal strings have
   equal minimizers. Hashes travel as sorted arrays, one for each block of documents and part of the hash space.
2. A minimizer found in one document alone cannot name a repeated string. The others go back to their blocks.
3. The stretches of text around them, cut so that each 50-byte string lies in one stretch of its minimizer, go to the
   part that holds the minimizer, each stretch once for a block. There the suffixes of the stretches are sorted by
   the difference cover modulo 3: sort the triples at the sampled places, recurse on their names, merge in the
   remaining suffixes. Neighbours in that order that agree in 50 bytes hold one string; its smallest doc_id is known.
4. The places whose string has a smaller doc_id elsewhere return to the block, which cuts the bytes.

A minimizer found in very many blocks (a common line) is dealt further by the 15 bytes before or after it, of which
every 50-byte string around it holds one or the other whole; again equal strings stay together.

Null text: empty. Texts of under 50 bytes never match. Equal doc_ids are one document split over rows: strings that
they share are not removed from either. Rows without a doc_id have none that are smaller or greater: they stay whole
and name nothing as repeated. An empty table gives an empty result.
Memory: a block's documents (about BLOCK bytes), or a part's stretches, worked on CHUNK bytes at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions

LENGTH = 50  # bytes of a repeated string
GRAM = 20  # bytes of a hashed string
BLOCK = 1 << 21  # bytes of a block's texts, about; a longer text makes a longer block
CHUNK = 1 << 18  # bytes sorted at once
PIECE = 1 << 16  # bytes hashed at once: few enough for a core's own cache
LONG = 4096  # bytes of a stretch beyond which it is hashed by itself
HOT = 64  # blocks beyond which a minimizer is dealt further
SIDE = 15  # bytes beside a hot minimizer that deal it further

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_STEP = 0x2C1B3C6D
_BYTES = ((np.arange(1, 257, dtype=np.uint64) * _C1) >> np.uint64(32)).astype(np.uint32)


# ---- suffix sorting ---------------------------------------------------------------------------------------------


def _names(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of rows of symbols, each row's name (from 1, equal rows alike), and the number of names."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:], strict=True):
            key = (key << b) | c
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    name = np.empty(len(order), np.int64)
    name[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    return order, name, int(name[order[-1]])


def suffix_order(symbols: np.ndarray, depth: int, reach: int = 1) -> np.ndarray:
    """The places of symbols (positive integers) in the order of their suffixes.

    reach is what a symbol spans of the text. Suffixes that agree in depth places of the text may come in any order.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols, np.zeros(3, symbols.dtype)]).astype(np.int64)
    # the sampled places: 1 and 2 modulo 3, with one beyond the end so that place n-1 modulo 1 is followed by nothing
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, name, kinds = _names(s[sample], s[sample + 1], s[sample + 2])
    if kinds < len(sample) and 3 * reach < depth:
        order = suffix_order(name, depth, 3 * reach)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    # the others: by first symbol and the rank of what follows
    rest = np.arange(0, n, 3)
    top = len(order) + 2
    key = s[rest] * top + rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    at_one, at_two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before_one = np.searchsorted(s[at_one] * top + rank[at_one + 1], key, side="left")
    # against place 2 modulo 3: two symbols, then a rank
    second = int(s.max()) + 1
    wide = second * second * top < 1 << 62
    if wide:
        two = (s[at_two] * second + s[at_two + 1]) * top + rank[at_two + 2]
        mine = (s[rest] * second + s[rest + 1]) * top + rank[rest + 2]
    else:
        pairs = np.concatenate([s[at_two], s[rest]]), np.concatenate([s[at_two + 1], s[rest + 1]])
        _, pair, _ = _names(*pairs)
        both = pair * top + np.concatenate([rank[at_two + 2], rank[rest + 2]])
        two, mine = both[: len(at_two)], both[len(at_two) :]
    before_two = np.searchsorted(np.maximum.accumulate(two), np.maximum.accumulate(mine), side="left")
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before_one + before_two
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sample
    return out


def repeated_strings(data: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """places in suffix order, and for each a number that equal strings of that length share."""
    keep = np.zeros(len(data), bool)
    keep[places] = True
    # a symbol of four bytes at each place, the end padded with zeros: triples then span six bytes
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(3, np.int64)])
    symbol = ((padded[:-3] * 257 + padded[1:-2]) * 257 + padded[2:-1]) * 257 + padded[3:]
    _, symbol, _ = _names(symbol)
    order = suffix_order(symbol, length)
    order = order[keep[order]]
    different = np.zeros(max(0, len(order) - 1), bool)
    bytes_ = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(bytes_, (len(bytes_) - 7, 8), (1, 1))
    for at in [*range(0, length - 8, 8), length - 8] if length >= 8 else []:
        eight = words[order + at].copy().view("<u8").ravel()
        different |= eight[1:] != eight[:-1]
    return order, np.concatenate([[0], np.cumsum(different)]).astype(np.int64)[: len(order)]


# ---- minimizers -------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C2
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number; data must go on for seven bytes beyond the last place read."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 20 bytes at each place: a polynomial by doubling (1, 2, 4, 8, 16 and then 16 with 4), mixed."""
    h, power, four = _BYTES[data], _STEP, None
    for size in (1, 2, 4, 8):
        more = h[:-size] * np.uint32(power)
        more += h[size:]
        h, power = more, power * power & 0xFFFFFFFF
        if size == 2:
            four = h
    n = len(data) - GRAM + 1
    h = h[:n] * np.uint32(pow(_STEP, 4, 1 << 32))
    h += four[16 : 16 + n]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return h


def minimizers(data: np.ndarray) -> np.ndarray:
    """Where the minimizer of the 50-byte string at each place begins: the first of the least hashes in it."""
    hashes = gram_hashes(data)
    low = hashes.astype(np.uint64)
    low <<= np.uint64(32)
    low |= np.arange(len(low), dtype=np.uint64)
    size, wide = 1, LENGTH - GRAM + 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _named(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of the 20 bytes at each of some places, evenly spread."""
    x = _mix(words[at] * _C1)
    x = _mix((x + words[at + 8]) * _C1)
    return _mix((x + words[at + GRAM - 8]) * _C1)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts hold ranges of names, in order."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _joined(starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow one another without a gap and have one key become one."""
    new = np.ones(len(starts), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != ends[:-1])
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    return starts[new], ends[last], keys[new]


class Texts:
    """The texts of a block in ascending doc_id order as one array of bytes."""

    def __init__(self, docs: pd.DataFrame):
        self.docs = docs.sort_values("doc_id", kind="stable")
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in self.docs["text"]]
        self.raw = b"".join([*raw, bytes(8)])
        self.padded = np.frombuffer(self.raw, np.uint8)
        self.data = self.padded[:-8]
        self.words = _words(self.padded)
        self.ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        self.ids = self.docs["doc_id"].to_numpy(np.int64)

    def runs(self, deal=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, keys: places start to end (not itself) whose 50-byte strings have one minimizer, in order.

        deal(starts, ends, keys, places of the minimizers) may choose among runs and cut them further.
        """
        parts = []
        for at in range(0, max(0, len(self.data) - LENGTH + 1), PIECE):
            low = minimizers(self.data[at : at + PIECE + LENGTH - 1])
            inside = np.zeros(len(low) + 1, np.int64)  # places whose string runs into the next text
            a, b = np.searchsorted(self.ends, [at, at + len(low) + LENGTH], side="right")
            near = self.ends[a:b] - at
            np.add.at(inside, np.clip(near - LENGTH + 1, 0, len(low)), 1)
            np.add.at(inside, np.clip(near, 0, len(low)), -1)
            valid = np.cumsum(inside)[:-1] == 0
            new = valid.copy()
            new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
            last = valid.copy()
            last[:-1] &= (low[1:] != low[:-1]) | ~valid[1:]
            starts = np.flatnonzero(new)
            places = low[starts] + at
            starts, ends, keys = starts + at, np.flatnonzero(last) + 1 + at, _named(self.words, places)
            if deal is not None:
                starts, ends, keys = deal(starts, ends, keys, places)
            parts.append(_joined(starts, ends, keys))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def _sides(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hot minimizers cut in two, with keys from the bytes before the minimizer where the string has them, or after."""
    turn = np.clip(places - SIDE + 1, starts, ends)  # strings from here on hold too little before the minimizer
    out = []
    for left, a, b, side in ((1, starts, turn, places - SIDE), (0, turn, ends, places + GRAM)):
        some = a < b
        at = side[some]
        tag = _mix((words[at] ^ _mix(words[at + SIDE - 8] * _C1)) * _C1)
        out.append((a[some], b[some], _mix((tag ^ _mix(keys[some] * _C1 + np.uint64(left))) * _C1)))
    starts, ends, keys = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], keys[order]


def _content(raw: bytes, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each stretch (of 50 at least)."""
    out = sizes.astype(np.uint64) * _C1
    live, at = np.arange(len(starts)), 0
    while len(live) and at < LONG:
        x = (out[live] ^ words[starts[live] + np.minimum(at, sizes[live] - 8)]) * _C2
        out[live] = x ^ (x >> np.uint64(29))
        at += 8
        live = live[sizes[live] > at]
    for i in live.tolist():
        a = int(starts[i])
        out[i] = int.from_bytes(hashlib.blake2b(raw[a : a + int(sizes[i])], digest_size=8).digest(), "little")
    return out


def _alike(raw: bytes, words: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether each stretch of sizes bytes at a is the same as that at b."""
    at = 0
    while len(a) and at < LONG:
        end = np.minimum(at, sizes - 8)
        if (words[a + end] != words[b + end]).any():
            return False
        at += 8
        rest = sizes > at
        a, b, sizes = a[rest], b[rest], sizes[rest]
    return all(raw[i : i + n] == raw[j : j + n] for i, j, n in zip(a.tolist(), b.tolist(), sizes.tolist(), strict=True))


class Stretches:
    """A block's stretches around repeated minimizers, each once, ordered by key, and where each lies."""

    def __init__(self, texts: Texts, known: pd.DataFrame, parts: int):
        found, hot = _known(known)

        def deal(starts, ends, keys, places):
            at = np.searchsorted(found, keys)
            at[at == len(found)] = 0
            pick = np.flatnonzero(found[at] == keys) if len(found) else np.zeros(0, np.int64)
            starts, ends, keys, places, often = starts[pick], ends[pick], keys[pick], places[pick], hot[at[pick]] if len(found) else np.zeros(0, bool)
            if not often.any():
                return starts, ends, keys
            more = _sides(texts.words, starts[often], ends[often], keys[often], places[often])
            starts, ends, keys = (np.concatenate([x[~often], y]) for x, y in zip((starts, ends, keys), more, strict=True))
            order = np.argsort(starts, kind="stable")
            return starts[order], ends[order], keys[order]

        starts, ends, keys = texts.runs(deal)
        size = ends - starts
        content = _content(texts.raw, texts.words, starts, size + LENGTH - 1)
        while True:
            order = np.lexsort((content, keys))
            self.starts, self.size, self.keys = starts[order], size[order], keys[order]
            sorted_ = content[order]
            new = np.ones(len(order), bool)
            new[1:] = (self.keys[1:] != self.keys[:-1]) | (sorted_[1:] != sorted_[:-1])
            self.first = np.flatnonzero(new)  # of the occurrences of each stretch
            first = self.first[np.cumsum(new) - 1]
            again = ~new
            same = (self.size[again] == self.size[first[again]]).all()
            if same and _alike(texts.raw, texts.words, self.starts[again], self.starts[first[again]], self.size[again] + LENGTH - 1):
                break
            # two stretches have one hash: the bytes themselves tell all apart
            numbers: dict[bytes, int] = {}
            spans = zip(starts.tolist(), (ends + LENGTH - 1).tolist(), strict=True)
            content = np.fromiter((numbers.setdefault(texts.raw[a:b], len(numbers)) for a, b in spans), np.uint64, len(starts))
        self.cuts = np.searchsorted(_part(self.keys[self.first], parts).astype(np.int64), np.arange(parts + 1))


# ---- the stages -------------------------------------------------------------------------------------------------


def _block_of(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))


def _hash_arrays(parts: int):
    """Blocks of documents to (part, block, hashes): the minimizers of a block, those of several documents marked."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        texts = Texts(block)
        starts, _, hashes = texts.runs()
        ids = texts.ids[texts.of(starts)]
        order = np.argsort(hashes, kind="stable")  # texts, and so runs, come in ascending id
        hashes, ids = hashes[order], ids[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        several = np.zeros(len(hashes), bool)
        several[1:] = ~new[1:] & (ids[1:] != ids[:-1])
        first = np.flatnonzero(new)
        hashes = hashes[first]
        part = _part(hashes, parts).astype(np.int64)
        several = np.logical_or.reduceat(several, first) if len(first) else several
        cuts = np.searchsorted(part, np.arange(parts + 1))
        here = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        return pd.DataFrame(
            {
                "part": np.array(here, np.int64), "block": np.full(len(here), block["block"].iloc[0], np.int64),
                "hashes": [hashes[cuts[p] : cuts[p + 1]].tobytes() for p in here],
                "several": [np.packbits(several[cuts[p] : cuts[p + 1]]).tobytes() for p in here],
            }
        )

    return run


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """A part's arrays to (block, hashes, hot): for each block those of its minimizers that other documents have."""
    arrays = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
    marks = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(a)].astype(bool) for a, b in zip(arrays, rows["several"], strict=True)]
    every, inverse, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    wanted = count > 1
    wanted[inverse[np.concatenate(marks)]] = True
    hot = count > HOT
    out, at = [], 0
    for block, a in zip(rows["block"], arrays, strict=True):
        i = inverse[at : at + len(a)]
        at += len(a)
        i = i[wanted[i]]
        if len(i):
            out.append((block, every[i].tobytes(), np.packbits(hot[i]).tobytes()))
    return pd.DataFrame(out, columns=["block", "hashes", "hot"])


def _known(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
    if not arrays:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    hot = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: len(a)].astype(bool) for a, b in zip(arrays, rows["hot"], strict=True)])
    found = np.concatenate(arrays)
    order = np.argsort(found, kind="stable")
    return found[order], hot[order]


def _send_stretches(parts: int):
    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(known):
            texts = Texts(docs)
            found = Stretches(texts, known, parts)
            ids = texts.ids[texts.of(found.starts)]
            least, most = (f.reduceat(ids, found.first) if len(ids) else ids for f in (np.minimum, np.maximum))
            starts, size = found.starts[found.first], found.size[found.first] + LENGTH - 1
            for p in range(parts):
                here = slice(int(found.cuts[p]), int(found.cuts[p + 1]))
                if here.start < here.stop:
                    data = b"".join([texts.raw[a : a + n] for a, n in zip(starts[here].tolist(), size[here].tolist(), strict=True)])
                    packed = [found.keys[found.first][here], size[here].astype(np.int32), least[here], most[here]]
                    out.append((p, docs["block"].iloc[0], *[x.tobytes() for x in packed], zstandard.compress(data, 1)))
        return pd.DataFrame(out, columns=["part", "block", "keys", "lengths", "least", "most", "data"])

    return run


def _least_owner(texts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each stretch: the stretch, and the smallest owner of any stretch with the string at that place."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = lengths - LENGTH + 1
    of = np.repeat(np.arange(len(texts)), counts)
    places = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]
    order, group = repeated_strings(data, places)
    least = np.zeros(len(data), np.int64)
    text_at = np.repeat(np.arange(len(texts)), lengths)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least[order] = np.minimum.reduceat(owners[text_at[order]], first)[group]
    return of, least[places]


def _sort_part(rows: pd.DataFrame) -> pd.DataFrame:
    """A part's stretches to (block, part, nth, starts, ends, least): runs of places whose string an earlier document has."""
    rows = rows.sort_values("block", kind="stable")
    seen: dict[tuple[int, bytes], int] = {}
    owner: list[int] = []
    back: list[np.ndarray] = []
    for r in rows.itertuples(index=False):
        keys, lengths, least = np.frombuffer(r.keys, np.uint64).tolist(), np.frombuffer(r.lengths, np.int32).tolist(), np.frombuffer(r.least, np.int64).tolist()
        own, at, data = np.empty(len(keys), np.int64), 0, zstandard.decompress(r.data)
        for i, (k, n, d) in enumerate(zip(keys, lengths, least, strict=True)):
            j = seen.setdefault((k, data[at : at + n]), len(owner))
            at += n
            if j == len(owner):
                owner.append(d)
            elif d < owner[j]:
                owner[j] = d
            own[i] = j
        back.append(own)
    names = sorted(seen)  # strings of one key together
    place = np.array([seen[n] for n in names], np.int64)
    owners = np.array(owner, np.int64)
    # runs of places of one stretch whose strings have one owner: (stretch, start, end, owner)
    key = np.array([k for k, _ in names], np.uint64)
    size = np.cumsum(np.array([len(t) for _, t in names], np.int64))
    texts = [t for _, t in names]
    runs = []
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK)) + 1
        end = int(np.searchsorted(key, key[min(end, len(texts)) - 1], side="right"))
        of, least = _least_owner(texts[at:end], owners[place[at:end]])
        cuts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])]))
        ends = np.concatenate([cuts[1:], [len(of)]])
        base = np.searchsorted(of, of[cuts])
        runs.append((place[at:end][of[cuts]], cuts - base, ends - base, least[cuts]))
        at = end
    stretch, start, stop, least = (np.concatenate(x) for x in zip(*runs, strict=True))
    by = np.argsort(stretch, kind="stable")
    start, stop, least = start[by], stop[by], least[by]
    pointer = np.searchsorted(stretch[by], np.arange(len(owners) + 1))
    out = []
    for r, own in zip(rows.itertuples(index=False), back, strict=True):
        count = pointer[own + 1] - pointer[own]
        nth = np.repeat(np.arange(len(own)), count)
        i = np.arange(len(nth)) - np.repeat(np.cumsum(count) - count, count) + pointer[own][nth]
        pick = least[i] < np.frombuffer(r.most, np.int64)[nth]
        if pick.any():
            nth, i = nth[pick], i[pick]
            pack = [nth.astype(np.int32), start[i].astype(np.int32), stop[i].astype(np.int32), least[i]]
            out.append((r.block, r.part, *[zstandard.compress(x.tobytes(), 1) for x in pack]))
    return pd.DataFrame(out, columns=["block", "part", "nth", "starts", "ends", "least"])


def _cut_block(parts: int, with_text: bool):
    def run(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        texts = Texts(docs)
        depth = np.zeros(len(texts.data) + 1, np.int32)  # starts less ends of removed strings
        answers = back[back["nth"].notna()]
        if len(docs) and len(answers):
            found = Stretches(texts, back[back["hashes"].notna()], parts)
            ids = texts.ids[texts.of(found.starts)]
            first = np.concatenate([found.first, [len(found.starts)]])
            for r in answers.itertuples(index=False):
                nth, a, b, low = (np.frombuffer(zstandard.decompress(x), t) for x, t in ((r.nth, np.int32), (r.starts, np.int32), (r.ends, np.int32), (r.least, np.int64)))
                u = nth + int(found.cuts[int(r.part)])
                count = first[u + 1] - first[u]
                of = np.repeat(np.arange(len(u)), count)
                at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[u][of]
                pick = low[of] < ids[at]
                of, at = of[pick], found.starts[at[pick]]
                np.add.at(depth, at + a[of], 1)
                np.add.at(depth, at + b[of] + LENGTH - 1, -1)
        gone = np.cumsum(depth)[:-1] > 0
        out, at = [], 0
        for doc_id, end, text in zip(texts.ids.tolist(), texts.ends.tolist(), texts.docs["text"], strict=True):
            cut, data = gone[at:end], texts.data[at:end]
            at = end
            removed = int(cut.sum())
            runs = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()) if removed else 0
            rest = (data[~cut] if removed else data).tobytes()
            row = (doc_id, len(data), removed, runs, hashlib.sha256(rest).hexdigest())
            if with_text:
                row += (hashlib.sha256(data).hexdigest(), rest.decode("utf-8", "ignore") if removed else text)
            out.append(row)
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["sha256", "kept"] * with_text])

    return run


def dedup_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with_text: sha256 of the whole text and kept, too
    (broken characters gone; null stays null). block: bytes of text worked on together, about."""
    every = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = every.where("doc_id is not null")
    spark = docs.sparkSession
    parts = max(1, partitions(spark))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    docs = _block_of(docs, blocks).repartition(parts, "block")
    arrays = docs.groupBy("block").applyInPandas(_hash_arrays(parts), "part int, block long, hashes binary, several binary")
    known = _by_part(arrays, parts).applyInPandas(_repeated, "block long, hashes binary, hot binary")
    known = known.repartition(parts, "block")
    sent = docs.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        _send_stretches(parts), "part int, block long, keys binary, lengths binary, least binary, most binary, data binary"
    )
    found = _by_part(sent, parts).applyInPandas(_sort_part, "block long, part int, nth binary, starts binary, ends binary, least binary")
    back = known.select(
        "block", "hashes", "hot", *[F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("nth", "binary"), ("starts", "binary"), ("ends", "binary"), ("least", "binary"))]
    ).union(found.select("block", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "part", "nth", "starts", "ends", "least"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", sha256 string, kept string" * with_text
    out = docs.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_cut_block(parts, with_text), schema)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    whole = F.sha2(raw, 256)
    unnamed = [F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), whole.alias("kept_sha256")]
    rest = every.where("doc_id is null").select("doc_id", *unnamed, *([whole.alias("sha256"), F.col("text").alias("kept")] if with_text else []))
    return out.unionByName(rest)


def _by_part(rows: DataFrame, parts: int):
    """rows grouped by part, each part in a partition of its own."""
    return rows.repartitionById(parts, "part").groupBy("part")


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """documents, all rows and columns, with repeated passages cut from text, and n_chars (if there) counted anew.

    Texts come back from the operator, so that the documents' own need not be moved again: a row finds its own by its
    doc_id and the digest of its text. Rows without a doc_id stay as they are.
    """
    named = documents.where("doc_id is not null")
    kept = dedup_passages(named, with_text=True, **options).select(F.col("doc_id").alias("kept_id"), "sha256", "kept").dropDuplicates(["kept_id", "sha256"])
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    rows = named.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), F.col("text").isNull().alias("none"))
    rows = rows.join(kept, (F.col("row_id") == F.col("kept_id")) & (F.col("digest") == F.col("sha256")))
    text = F.when(~F.col("none"), F.coalesce("kept", F.lit("")))
    out = {c: F.col("row").getField(c) for c in documents.columns if c != "text"} | {"text": text}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.length(text).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) for c in documents.columns]).unionByName(documents.where("doc_id is null"))

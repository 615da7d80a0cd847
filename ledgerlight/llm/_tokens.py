"""Ids of whole texts by the tokenizers library, each different piece of text encoded once.

The library's pre-tokenizers cut a text by classes of characters (letters, numbers, white space, others), which arrays do
for many texts at once. Pieces of up to 16 bytes are looked up by those bytes in a table of arrays, longer ones in a
dictionary; pieces that are new go to the library's model, many at a time, without its normalizer and pattern.

The classes are those of Unicode. A text that holds a character whose class has changed since Unicode 3.2 (the library may
know another version), a NUL, the beginning of a special token or, where case is folded, a capital sigma goes to the
library whole: equal ids, more time.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from ._common import forget

KEPT = 1_000_000  # pieces remembered at most; then the memory begins anew
TOGETHER = 1 << 18  # characters of text looked at together
LONGEST = 1 << 20  # characters of a text beyond which it is looked at in parts
JOINED = 400  # pieces encoded as one text

SPACE, LETTER, NUMBER, OTHER, BREAK, UNSURE = range(6)
# fixed values: Unicode's white space
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPECIAL = "<|"
_SIGMA = "Σ"
_END = "</w>"
_SAFE = re.compile("[A-Za-z] (?=[A-Za-z])")  # a piece always begins at the space

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point under 0x20000; beyond, and where versions of Unicode differ, unsure."""

    def group(category: str) -> int:
        return LETTER if category[0] == "L" else NUMBER if category[0] == "N" else SPACE if category[0] == "Z" else OTHER

    out = np.full(0x20001, UNSURE, np.uint8)
    for c in range(0x20000):
        now = unicodedata.category(chr(c))
        kind, before = group(now), group(unicodedata.ucd_3_2_0.category(chr(c)))
        if now != "Cn" and kind == before:
            out[c] = kind
    out[0x2028:0x2030][out[0x2028:0x2030] == SPACE] = OTHER
    out[list(_WHITE)] = SPACE
    out[0] = BREAK
    return out


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it can be seen, else from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


def piece_starts(codes: np.ndarray, kinds: np.ndarray, joins: bool) -> np.ndarray:
    """Where pieces begin. joins: a single space goes with what follows it; else each number is a piece of its own."""
    start = np.ones(len(codes), bool)
    start[1:] = kinds[1:] != kinds[:-1]
    if joins:
        word = (kinds == LETTER) | (kinds == NUMBER) | (kinds == OTHER)
        last = np.flatnonzero((kinds[:-1] == SPACE) & word[1:])  # of the white space before a word
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
    else:
        start[kinds == NUMBER] = True
    # contractions, where the apostrophe is not the end of something else
    quote = np.flatnonzero((codes[:-2] == 39) & start[:-2])
    if len(quote):
        one, two = codes[quote + 1], codes[quote + 2]
        single = np.isin(one, (115, 116, 109, 100))  # s t m d
        double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))  # re ve ll
        start[quote[single | double] + 1] = False
        start[quote[single] + 2] = True
        start[quote[double] + 3] = True
    return start


class _Table:
    """Numbers of pieces of 1 to 16 bytes without a NUL, by their bytes as two words; open addressing over arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.a, self.b = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.zeros(1 << bits, np.int32)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a * _C1) ^ (b * _C2)
        h ^= h >> np.uint64(32)
        h *= _C1
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where there is none."""
        at = self._slots(a, b)
        held = self.a[at]
        out = np.where((held == a) & (self.b[at] == b), self.number[at], -1)
        todo = np.flatnonzero((out < 0) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.a) - 1)
            here = at[todo]
            held = self.a[here]
            hit = (held == a[todo]) & (self.b[here] == b[todo])
            out[todo[hit]] = self.number[here[hit]]
            todo = todo[~hit & (held != 0)]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        self.size += len(a)
        if 2 * self.size > len(self.a):
            full = self.a != 0
            a, b, number = (np.concatenate(x) for x in ((self.a[full], a), (self.b[full], b), (self.number[full], number)))
            while 2 * self.size > 1 << self.bits:
                self.bits += 1
            self.a, self.b = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
            self.number = np.zeros(1 << self.bits, np.int32)
        at = self._slots(a, b)
        while len(a):
            free = np.flatnonzero(self.a[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            take = free[first]
            self.a[at[take]], self.b[at[take]], self.number[at[take]] = a[take], b[take], number[take]
            rest = np.ones(len(a), bool)
            rest[take] = False
            a, b, number, at = a[rest], b[rest], number[rest], (at[rest] + 1) & (len(self.a) - 1)


class Encoder:
    """kind: "space" for byte-level vocabularies, "word" for those that fold case and drop white space."""

    def __init__(self, path: str, kind: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.end = np.array([] if end_id is None else [end_id], "<u4")
        # the vocabulary alone: pieces come in its own letters, one a line
        vocabulary = made["model"]["vocab"]
        self.plain = Tokenizer.from_str(
            json.dumps({**made, "normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "post_processor": None, "decoder": None, "added_tokens": []})
        )
        self.letters = _byte_letters() | {0: 10}
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)  # letters of each id
        for word, i in vocabulary.items():
            self.length[i] = len(word.removesuffix(_END)) if kind == "word" else len(word)
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = _Table(), {}
        self.ids, self.used = np.zeros(1 << 12, "<u4"), 0  # of all pieces known, one after another
        self.starts, self.counts, self.known = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, whose ids are kept."""
        first = self.known
        parts = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        lines = [b"\0".join(p).decode("latin-1").translate(self.letters) for p in parts]
        for part, line, got in zip(parts, lines, self.plain.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            breaks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 10)
            ends = np.append(breaks, len(line)) - np.arange(len(part))  # without the breaks themselves
            reached = np.cumsum(self.length[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if len(ids) == 0 or cuts[-1] != len(ids) or (reached[cuts - 1] != ends).any():
                each = [np.array(self.plain.encode(p.decode("latin-1").translate(self.letters), add_special_tokens=False).ids, "<u4") for p in part]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            self._keep(ids, cuts)
        return np.arange(first, self.known)

    def _keep(self, ids: np.ndarray, cuts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(cuts) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], cuts[:-1]])
        self.starts[self.known : self.known + len(cuts)] = self.used + begins
        self.counts[self.known : self.known + len(cuts)] = cuts - begins
        self.used += len(ids)
        self.known += len(cuts)

    def _numbers(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece raw[begin:end]; raw goes on for 16 bytes beyond the last. New pieces are learned."""
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        size = ends - begins
        a = words[begins] & _MASKS[np.minimum(size, 8)]
        b = words[np.minimum(begins + 8, len(words) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
        short = size <= 16
        out = self.table.find(a, b)
        if (new := np.flatnonzero((out < 0) & short)).size:
            order = np.lexsort((b[new], a[new]))
            x, y = a[new][order], b[new][order]
            first = np.ones(len(x), bool)
            first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = new[order[first]]
            spans = zip(begins[at].tolist(), ends[at].tolist(), strict=True)
            numbers = self._learn([raw[i:j] for i, j in spans])
            self.table.add(x[first], y[first], numbers.astype(np.int32))
            out[new[order]] = numbers[np.cumsum(first) - 1]
        if (far := np.flatnonzero(~short)).size:
            pieces = [raw[i:j] for i, j in zip(begins[far].tolist(), ends[far].tolist(), strict=True)]
            missing = list(dict.fromkeys(p for p in pieces if p not in self.long))
            if missing:
                self.long.update(zip(missing, self._learn(missing).tolist(), strict=True))
            out[far] = [self.long[p] for p in pieces]
        return out

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        held: list[str] = []
        size = 0
        for t in texts:
            if t and len(t) > LONGEST:
                yield from self._some(held)
                held, size = [], 0
                yield np.concatenate([*[ids[: len(ids) - len(self.end)] for p in _parts(t) for ids in self._some([p])], self.end])
                continue
            held.append(t or "")
            size += len(t or "")
            if size >= TOGETHER:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.known > KEPT:
            self._forget()
        odd = {i for i, t in enumerate(texts) if "\0" in t or _SPECIAL in t or (self.kind == "word" and _SIGMA in t)}
        while True:
            plain = [t for i, t in enumerate(texts) if i not in odd]
            joined = "\0".join([*plain, ""])
            if self.kind == "word":
                joined = unicodedata.normalize("NFC", joined).lower()
            codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            kinds = classes()[np.minimum(codes, 0x20000)]
            unsure = np.flatnonzero(kinds == UNSURE)
            if not len(unsure):
                break
            place = [i for i in range(len(texts)) if i not in odd]
            odd.update(place[k] for k in np.searchsorted(np.flatnonzero(kinds == BREAK), np.unique(unsure)).tolist())
        out: list[np.ndarray | None] = [None] * len(texts)
        for i in odd:
            out[i] = np.concatenate([self._encode(texts[i]), self.end])
        if plain:
            for i, ids in zip((i for i in range(len(texts)) if i not in odd), self._plain(joined, codes, kinds), strict=True):
                out[i] = ids
        return out  # type: ignore[return-value]

    def _plain(self, joined: str, codes: np.ndarray, kinds: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text of joined, which ends each with a NUL."""
        begins = np.flatnonzero(piece_starts(codes, kinds, self.kind == "space"))
        ends = np.append(begins[1:], len(codes))
        pick = kinds[begins] != BREAK
        if self.kind == "word":
            pick &= kinds[begins] != SPACE
        begins, ends = begins[pick], ends[pick]
        breaks = np.searchsorted(begins, np.flatnonzero(kinds == BREAK))  # pieces before the end of each text
        raw = joined.encode() + bytes(16)
        if len(raw) != len(codes) + 16:
            width = np.ones(len(codes) + 1, np.int64)
            width[0] = 0
            width[1:] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            place = np.cumsum(width)
            begins, ends = place[begins], place[ends]
        numbers = self._numbers(raw, begins, ends)
        counts = self.counts[numbers]
        reached = np.cumsum(counts)
        total = int(reached[-1]) if len(reached) else 0
        ids = self.ids[np.repeat(self.starts[numbers] - (reached - counts), counts) + np.arange(total)]
        reached = np.concatenate([[0], reached])[breaks].tolist()
        at = 0
        for to in reached:
            yield np.concatenate([ids[at:to], self.end])
            at = to


def _parts(text: str) -> Iterator[str]:
    """A long text cut where a piece begins, about every TOGETHER characters; where there is no such place, not at all."""
    at = 0
    while len(text) - at > TOGETHER:
        m = _SAFE.search(text, at + TOGETHER)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


@lru_cache(maxsize=4)
def encoder(path: str, kind: str, end_id: int | None = None) -> Encoder:
    """An encoder that a Python worker keeps from task to task."""
    return Encoder(path, kind, end_id)


forget.append(encoder.cache_clear)

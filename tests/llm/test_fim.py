"""Fill-in-middle against brute force: chunks of a few bytes, marks across them, nulls, repeated rows, long texts, empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string, digest string, chunk int, piece binary, first long, second long, marked boolean, p string, of long, cuts string"


def brute(doc_id, text, rate=100, spm=50, marks=fim.MARKS):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    pieces = ["\n", "\n\n", "word ", "é日本🙂", "<", "P", ">", "<P", "S>", "<<M", "M>>", "\r\n", " "]
    out = [(i, "".join(r.choice(pieces) for _ in range(r.choice([0, 1, 2, 6, 14, 40])))) for i in range(150)]
    out += [(200 + i, f"clean {i}\nsecond line\n\nlast é line" + "\n" * (i % 2)) for i in range(60)]
    out += [(300, None), (301, ""), (302, "\n"), (303, "no line feed"), (304, "\n\n\n"), (305, "x" * 300_000), (306, ("long line é\n" * 30_000)), (307, "y" * 70_000 + "<P" + ">\n")]
    out += [(None, "no number\nhere"), (None, "no number\nhere"), (None, None), (210, "clean 10\nsecond"), (211, None), out[4], out[4], (306, out[-2][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, 1, "f", "o", "d", 1, b"p", 1, 2, True, "p", 3, "c") for x in rows], SCHEMA).repartition(3)


def seen(df):
    return collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect())


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_equal_to_brute_force_for_any_chunks(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    some = rows if chunk > 5 else [x for x in rows if len(x[1] or "") < 1000]
    given = docs if chunk > 5 else docs.where("text is null or length(text) < 1000")
    out = fim.transform(given)
    assert seen(out) == collections.Counter((i, *brute(i, t)) for i, t in some)
    back = out.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((i, t or "") for i, t in some)


def test_rates_and_other_marks(spark, rows):
    marks = ("<pre>", "<suf>", "<pm>")
    some = [(i, (t or "") + ("<p<pm>" if (i or 1) % 9 == 0 else "<p<pm")) for i, t in rows if len(t or "") < 1000]
    out = fim.transform(spark.createDataFrame(some, "doc_id long, text string"), marks, rate=60, spm=20)
    assert seen(out) == collections.Counter((i, *brute(i, t, 60, 20, marks)) for i, t in some)
    back = out.select("doc_id", fim.restored(F.col("form"), F.col("output"), marks).alias("text")).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter(some)


def test_functions_compose_to_what_one_reading_gives():
    m, r = fim.automaton(), random.Random(1)
    for _ in range(60):
        data = np.frombuffer("".join(r.choice(["\n", "a", "<", "P", ">", "<M>", "é"]) for _ in range(r.randint(1, 60))).encode(), np.uint8)
        at = sorted({0, len(data), *(r.randrange(len(data) + 1) for _ in range(4))})
        parts = [fim.scan(data[a:b], m)[0].whole for a, b in zip(at, at[1:], strict=False)]
        tree, (to, count) = fim.Tree(np.array([p[0] for p in parts]), np.array([p[1] for p in parts])), fim.scan(data, m)[0].whole
        assert (tree.whole[0] == to).all() and (tree.whole[1] == count).all()
        for s in range(len(m.step)):  # a reading byte by byte, from every state
            state, found = s, []
            for i, b in enumerate(data.tolist()):
                c = m.classes[b]
                found += [i] * int(m.ends[state, c])
                state = int(m.step[state, c])
            assert (state, len(found)) == (to[s], count[s])
            for k, place in enumerate(found, 1):
                piece, entry, nth = tree.select(s, k)
                inner, places = fim.scan(data[at[piece] : at[piece + 1]], m)
                assert at[piece] + places[inner.select(entry, nth)[0]] == place


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []

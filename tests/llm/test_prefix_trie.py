"""The conversation trie against brute force: nulls, ties, turnless and long conversations, absent lenders, empty tables."""

import collections
import hashlib
import random
import zlib

import pytest

from ledgerlight.llm import prefix_trie
from ledgerlight.llm._common import cut

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a long, b long, n long, first long, held long, size long, at long, digest string, path string, level long"


def conversation(r, i):
    kinds = [("user", "hello"), ("assistant", "yes"), ("assistant", "nö, é"), ("user", None), (None, "x"), (None, None), ("user", "")]
    n = r.choice([0, 1, 2, 3, 5, 9, 12])
    return [(i, t, *(kinds[0] if t == 0 and i % 3 else r.choice(kinds[: 2 + i % 6]))) for t in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [x for i in [*range(0, 120), *range(300, 360, 7), -3, -10, 2**40 + 1] for x in conversation(r, i)]
    out += [(200 + i, t, "user", f"common {t}") for i in range(40) for t in range(3)]  # a third of all conversations alike
    out += [(500, t, "user", f"long {t}") for t in range(400)] + [(501, t, "user", f"long {t}") for t in range(380)]
    out += [(500, None, "system", "first"), (600, 1, "a", "tie"), (600, 1, "b", "tie"), (600, 1, "b", "tie"), (601, None, "a", "b"), (None, 0, "a", "b"), (None, None, None, None)]
    r.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, *[7] * 8, "d", "p", 7) for x in rows], SCHEMA)


def brute(rows, span=5, most=8):
    told = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            x = (role or "", text or "")
            raw = f"{len(x[0].encode())}:{x[0]}{x[1]}".encode()
            told[c].append(((-1 << 70) if turn is None else turn, hashlib.sha256(raw).hexdigest(), x))
    told = {c: [x for *_, x in sorted(t)] for c, t in told.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = told.get(c - (c % span if c >= 0 else -(-c % span)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def as_dict(df):
    got = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def test_equal_to_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    assert as_dict(prefix_trie.trie(frame(spark, rows).repartition(3))) == brute(rows)


def test_conversations_as_they_are(spark, rows):
    some = [x for x in rows if x[0] is not None and x[0] < 40]
    assert as_dict(prefix_trie.trie(frame(spark, some), span=1)) == brute(some, span=1)


def test_light_edges_are_few_and_paths_cover_the_tree(spark, rows):
    lined, every = prefix_trie.rebuilt(frame(spark, rows), span=1)
    lined = cut(prefix_trie.beginnings(lined))
    tree = prefix_trie.paths(cut(prefix_trie.linked(cut(prefix_trie.nodes(lined, every)))), lined).collect()
    assert max(r["level"] for r in tree) <= every.count().bit_length()
    by_path = collections.defaultdict(list)
    for r in tree:
        by_path[r["path"]].append(r["depth"])
    assert all(sorted(d) == list(range(min(d), max(d) + 1)) for d in by_path.values())  # each path is one chain
    assert len(by_path) == sum(r["n_children"] == 0 for r in tree)
    half = {(r["depth"], r["a"], r["b"]): r["n_convs"] for r in tree}
    assert all(2 * r["n_convs"] <= half[r["up_depth"], r["up_a"], r["up_b"]] for r in tree if r["light"])


def test_turnless_and_empty(spark):
    donors = [(c, 0, "u", "t") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]  # lenders are absent
    assert as_dict(prefix_trie.trie(frame(spark, donors))) == brute(donors)
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    assert prefix_trie.trie(frame(spark, [(None, 1, "a", "b")])).collect() == []

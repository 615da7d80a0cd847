"""Exact dedup against brute force: nulls, repeated rows, equal beginnings, hot groups, clashing columns, empty tables."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import exact_dedup
from ledgerlight.llm._common import attach

SCHEMA = "doc_id long, text string, n long, start long, whole string, at long, held long, word long, mask long, row string, kept string"


@pytest.fixture(scope="module")
def rows():
    begin = "the same beginning of many texts " * 20
    out = [(i, begin + f"{i % 7:03d}") for i in range(60)]  # one length, one beginning, seven texts
    out += [(100 + i, "hot copy") for i in range(120)] + [(300 + i, f"{i:05d}" * 3) for i in range(30)]  # one length, all different
    out += [(400, ""), (401, None), (402, " "), (403, "é"), (404, "é"), (405, "x" * 400_000), (406, "x" * 400_000), (407, "x" * 399_999 + "y")]
    out += [(None, "no id"), (None, "no id"), (None, "hot copy"), (500, "twice"), (500, "twice"), (500, "other"), (501, "twice"), (502, "again"), (502, "again")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w", 3, 4, 5, 6, "r", "k") for r in rows], SCHEMA).repartition(3)


def test_classes_equal_brute_force(docs, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup.classes(docs, sha=F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): sorted(ids, key=lambda i: -1 if i is None else i) for t, ids in groups.items()}
    seen, kept = collections.Counter(), collections.Counter()
    for r in got:
        ids = by_sha[r["sha"]]
        assert r["keep_id"] == ids[-1] and r["group_size"] == len(ids)
        seen[r["sha"], r["doc_id"]] += 1
        if r["kept"]:
            kept[r["sha"]] += 1
            assert r["doc_id"] == ids[-1]
    assert seen == collections.Counter((s, i) for s, ids in by_sha.items() for i in ids)
    assert kept == collections.Counter(dict.fromkeys(by_sha, 1))


def test_only_texts_of_repeated_beginnings_are_hashed_whole(docs):
    n, start = F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("start")
    pairs = docs.select(n.cast("long"), start).groupBy("n", "start").agg(F.count("*").alias("held"))
    bits = exact_dedup.repeated(pairs).agg(F.sum(F.bit_count("mask"))).first()[0]
    assert bits == pairs.where("held > 1").count() < pairs.count()


def test_deduplicated_keeps_one_of_each_text_and_every_column(docs, rows):
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"] or "") for r in out.collect())
    named = {}
    for i, t in rows:
        if i is not None:
            named[t or ""] = max(i, named.get(t or "", -1))
    assert {k for k in got if k[0] is not None} == {(i, t) for t, i in named.items()}
    assert sum(n for (i, _), n in got.items() if i is None) == 3  # rows without an id stay


def test_empty_table(spark):
    assert exact_dedup.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_attach_meets_hot_and_other_keys(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("held"), F.max("id").alias("top")).where("k % 3 != 0")
    got = {r["id"]: r["top"] for r in attach(rows, facts, "k").collect()}
    assert got == {i: 1999 if i < 2000 else i if i % 3 else None for i in range(6000)}

"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, columns of clashing names."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import html_main, mixture, mtree, near_copies, packing, sharding, simhash, spotsigs, suffix_dedup, token_store, toxicity
from ledgerlight.llm.queries import tokenizer_path

CLASHES = (
    "size _id _kept _nth copies copy toxic toxicity row row_id kept kept_id sha256 digest none part block key node root component_id fingerprint fp first "
    "a b x y h g words weight target source_size taken level bucket _micro _v _end _source _rate slices slice tokens bits n loss data name store kind start"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int" + "".join(f", {c} string" for c in CLASHES)
LONG = 1_300_000


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    line = prose(r, 30)
    out = [(i, prose(r, r.randint(0, 60)) + (line if i % 4 == 0 else ""), r.choice(["en", "de", None]), r.choice(["a", "b", None]), 1) for i in range(40)]
    out += [(50, "", "en", "a", 0), (51, None, None, None, None), (52, "word " * (LONG // 5), "en", "b", LONG), (53, "ab" * 30_000, "en", "b", 60_000)]
    out += [(None, "no id " + line, "en", "a", 1), (None, "no id " + line, "en", "a", 1), (None, None, None, None, None)]
    out += [out[4]] * 3 + [(7, "another text of a repeated id", "en", "a", 1), (60, out[8][1], "en", "a", 1)]
    return [(*x, *["c"] * len(CLASHES)) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, i % 2, "x") for i in range(0, 40, 3)] + [(None, 1, 1, "x"), (4, None, None, None), (4, 1, 1, "x"), (4, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, lang string")


@pytest.fixture(scope="module")
def folder(spark, labels, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_suffix_dedup(docs, rows):
    got = sorted(map(tuple, suffix_dedup.dedup_passages(docs).collect()), key=str)
    texts: dict = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").encode())
    owner: dict[bytes, int] = {}
    for d in sorted(k for k in texts if k is not None):
        for t in texts[d]:
            for i in range(len(t) - 49):
                owner.setdefault(t[i : i + 50], d)
    want = []
    for d, some in texts.items():
        for t in some:
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - 49) if d is not None else ():
                if owner[t[i : i + 50]] < d:
                    gone[i : i + 50] = True
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    assert got == sorted(want, key=str)


def test_suffix_dedup_in_many_chunks(docs, monkeypatch):
    want = sorted(map(tuple, suffix_dedup.dedup_passages(docs).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert sorted(map(tuple, suffix_dedup.dedup_passages(docs, block=3000).collect()), key=str) == want


def test_stretches_of_one_hash_are_told_apart(monkeypatch):
    import pandas as pd

    r = random.Random(3)
    texts = suffix_dedup.Texts(pd.DataFrame({"doc_id": range(20), "text": [prose(r, 40) for _ in range(10)] * 2}))
    low = np.unique(texts.runs()[2])
    known = pd.DataFrame({"hashes": [low.tobytes()], "hot": [np.packbits(np.zeros(len(low), bool)).tobytes()]})
    want = suffix_dedup.Stretches(texts, known, 3)
    monkeypatch.setattr(suffix_dedup, "_content", lambda raw, words, starts, sizes: np.zeros(len(starts), np.uint64))
    got = suffix_dedup.Stretches(texts, known, 3)
    names = lambda s: sorted(texts.raw[a : a + n + 49] for a, n in zip(s.starts[s.first].tolist(), s.size[s.first].tolist(), strict=True))
    assert names(got) == names(want)


def test_mixture(docs, rows, empty):
    got = mixture.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.mix(docs.coalesce(1)).collect()), key=str)
    by: dict = {}
    for g in got:
        assert 0 <= g["copies"] <= 3 and g["taken"] == g["size"] * g["copies"]
        by.setdefault(g["source"], []).append(g)
    for some in by.values():
        assert abs(sum(g["taken"] for g in some) - some[0]["target"]) <= max(g["size"] for g in some)
    out = mixture.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(g["copies"] for g in got)
    assert mixture.mixed(empty).count() == 0


@pytest.mark.parametrize("operator", [simhash, near_copies])
def test_near_duplicates(operator, docs, empty):
    out = operator.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert ids.count(None) == 3 and 60 not in ids and 8 in ids
    assert operator.deduplicated(empty).count() == 0


def test_token_store_finds_damage(spark, docs, rows, tmp_path):
    path, store = tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/store"
    got = token_store.round_trip(docs, path, store=store).collect()
    assert len(got) == len(rows) and sorted(g["start"] for g in got) == np.cumsum([0, *(g["n_tokens"] for g in sorted(got, key=lambda g: g["start"]))])[:-1].tolist()
    items, root = spark.read.parquet(f"{store}/items"), spark.read.parquet(f"{store}/root")
    some = items.where("kind = 'chunk'").orderBy("name").first()["name"]
    changed = {
        "chunk": items.withColumn("data", F.when((F.col("kind") == "chunk") & (F.col("name") == F.lit(some)), F.concat(F.col("data"), F.unhex(F.lit("0000")))).otherwise(F.col("data"))),
        "missing": items.where((F.col("kind") != "chunk") | (F.col("name") != F.lit(some))),
        "recipe": items.where("kind != 'recipe' or doc_id is null or doc_id != 3"),
        "start": items.withColumn("start", F.when((F.col("kind") == "recipe") & (F.col("doc_id") == 5), F.col("start") + 1).otherwise(F.col("start"))),
        "manifest": items.where("kind != 'manifest' or part != 0 or cast(data as string) != 'recipe'"),
    }
    for what, rows_ in changed.items():
        rows_.write.parquet(f"file://{tmp_path}/{what}/items")
        root.write.parquet(f"file://{tmp_path}/{what}/root")
        with pytest.raises((ValueError, PySparkException)):
            token_store.read(spark, f"file://{tmp_path}/{what}").collect()


@pytest.mark.parametrize("lost", [0, 1, -1, "root"])
def test_token_store_finds_a_lost_file(spark, docs, tmp_path, lost):
    store = tmp_path / "store"
    token_store.write(docs, f"file://{store}", tokenizer_path("byte_bpe_50k.json"))
    assert token_store.read(spark, f"file://{store}").count() == docs.count()
    files = sorted((store / ("root" if lost == "root" else "items")).glob("*.parquet"))
    files[0 if lost == "root" else lost].unlink()
    with pytest.raises((ValueError, PySparkException)):
        token_store.read(spark, f"file://{store}").collect()


def test_packing_many_tiny_documents_in_linear_time():
    took = []
    for n in (25_000, 100_000):
        lengths, began = np.full(n, 5) + np.arange(n) % 3, time.process_time()
        out = packing.pack(lengths, np.zeros(n, np.int64))
        took.append(time.process_time() - began)
        sizes = [sum(p[2] for p in s) for s in out]
        assert sum(sizes) == lengths.sum() and max(map(len, out)) <= packing.SEGMENTS
        assert all(x & (x - 1) == 0 for x in sizes)  # full or a power of two: no padding, though segments run out first
        assert sorted(p for s in out for p in s) == sorted(set(p for s in out for p in s))
    assert took[1] < 10


def test_packing_a_window_of_null_texts_only(spark):
    docs = spark.createDataFrame([(i, None) for i in range(3000)], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and all(r["length"] == 1 for r in got)


def test_top_k_of_large_values(spark):
    r = np.random.default_rng(2)
    x = [r.normal(size=5).tolist() for _ in range(120)]
    x += [[1e7, -1e7, 3.0, 0.5, 1e6], [1e9, 0.0, 0.0, 1.0, 1.0], [1e9, 0.0, 0.0, 1.0, 1.015625], [-1e9, 5.0], [1e300] * 5, [0.0] * 5]
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, v string")
    got: dict = {}
    for q, rank, i, s in map(tuple, mtree.top_k(df, F.col("vec_id") % 3 == 0, branch=30, query_block=9).collect()):
        got.setdefault(q, {})[rank] = (i, s)
    whole = [[int(min(1e300, max(-1e300, 64 * e))) if abs(e) >= 1e15 else int(np.floor(64 * e)) for e in v] + [0] * (5 - len(v)) for v in x]
    for q in range(0, len(x), 3):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:20]
        assert [got[q][k] for k in range(1, 21)] == [(i, max(min(-s, 2**63 - 1), -(2**63))) for s, i in scores], q


def test_spotsigs_and_shards(docs, rows, empty):
    got = spotsigs.compared(docs).collect()
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows) and all(0 <= g["near_next"] <= 1 and 0 <= g["near_edited"] <= 1 for g in got)
    by = {}
    for g in got:
        by.setdefault((g["doc_id"], g["n_chars"]), set()).add(g["edited_sha256"])
    singles = [i for i, r in enumerate(texts) if sum(x[0] == r[0] for x in texts) == 1]
    for i in singles:
        after = texts[(i + 1) % len(texts)]
        if sum(x[0] == after[0] for x in texts) == 1:
            t, u = texts[i][1] or "", after[1] or ""
            want = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            assert by[(texts[i][0], len(t))] == {hashlib.sha256(want.encode()).hexdigest()}
    dealt = sharding.shard(docs).collect()
    assert sorted((d["size"], d["text_crc32"]) for d in dealt) == sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert spotsigs.compared(empty).count() == sharding.shard(empty).count() == 0


def test_packing(docs, rows, empty):
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path).collect()
    assert max(sum(g["length"] for g in got if g["sequence_id"] == s) for s in {g["sequence_id"] for g in got}) <= 4096
    long = [g for g in got if g["doc_id"] == 52]
    assert sum(g["length"] for g in long) == long[0]["doc_tokens"] > 200_000
    assert sum(g["length"] for g in got if g["doc_id"] is None) == sum(g["doc_tokens"] for g in got if g["doc_id"] is None and g["start"] == 0)
    assert packing.pack_documents(empty, path).count() == 0


def test_pages(spark):
    page = "<nav><a>Menu</a></nav><article><h1>Title of it</h1>" + "<p>some words of a long article, again and again.</p>" * 3000 + "</article>"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "y"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_main.extract(df).collect()
    assert len(got) == 3 and sum(g["n_chars"] > 100_000 for g in got) == 2
    assert html_main.extract(df.limit(0)).count() == 0


def test_toxicity(docs, rows, empty, labels):
    got = toxicity.classify(docs, labels)
    assert got.count() == len(rows)
    kept = toxicity.filtered(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("not rejected").count()
    assert toxicity.filtered(empty, labels).count() == 0 and toxicity.filtered(docs, labels.limit(0)).count() == len(rows)


def test_stages_keep_columns(spark, docs, empty, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert out.count() > 10, name
        assert stage(spark, empty, folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > len({r[0] for r in docs.collect()}) - 1
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0


def test_toxicity_is_not_fitted_on_the_driver(spark, monkeypatch):
    driver, fit_chain = os.getpid(), toxicity.fit_chain

    def elsewhere(*sample):
        assert os.getpid() != driver
        return fit_chain(*sample)

    docs = spark.createDataFrame([(i, "vile scum words" if i % 2 else "kind and calm words", "en") for i in range(40)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit_chain", elsewhere)
    chain = toxicity.train(docs, known)
    monkeypatch.undo()
    assert len(chain) == len(toxicity.CATEGORIES)
    scorer = toxicity.Scorer(chain)
    assert scorer.score("vile scum words")[-1] > 0.5 > scorer.score("kind and calm words")[-1]


def test_links_broadcast_no_copies(spark):
    """A fingerprint's copies are many times the size that Spark takes them for, so neither side of their join is broadcast."""
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp")).union(spark.createDataFrame([(0,), (15,), (31,)], "fp long"))
    found = simhash.links(fps.groupBy("fp").agg(F.count("*").alias("n")))
    assert {(r["a"], r["b"]) for r in found.collect()} >= {(0, 15), (15, 31)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan

"""The pipeline's stage of near copies against brute force."""

import random

import corpus_pipeline
from ledgerlight.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in texts})


def test_near_dedup_stage_drops_every_copy_of_similarity_0_8(spark, tmp_path):
    r = random.Random(5)
    line = [f"c{k}" for k in range(30)]
    texts, base = {}, [[f"w{r.randrange(5000)}" for _ in range(r.randint(40, 300))] for _ in range(25)]
    for b in base:
        for edits in (0, 0, 1, 2, 3, 5, 8, 12):
            words = list(b)
            for _ in range(edits):
                words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
            texts[len(texts)] = " ".join(words)
    for _ in range(40):  # a line that unrelated documents share
        texts[len(texts)] = " ".join([*line, *(f"w{r.randrange(5000)}" for _ in range(60))])
    for n in (0, 0, 1, 3, 3, 4, 5, 6):
        texts[len(texts)] = " ".join(f"s{k}" for k in range(n))
    texts[len(texts)] = None
    order = list(texts)
    r.shuffle(order)
    texts = {order[i]: t for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    want = brute_kept(texts)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == want
    assert len(want) < len(texts) - 80


def test_prefixes_of_alike_sets_meet():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, r.integers(1, 40)))
        b = np.unique(np.concatenate([r.permutation(a)[r.integers(0, 4) :], r.integers(-(1 << 62), 1 << 62, r.integers(0, 4))]))
        common = np.sort(r.permutation(a)[: r.integers(0, len(a))])
        if len(b) and alike(set(a.tolist()), set(b.tolist())):
            assert set(near_copies.prefix(a, common).tolist()) & set(near_copies.prefix(b, common).tolist())


def test_sets_of_one_name_stay_apart(spark, monkeypatch):
    """Different sets whose first 64 bits agree are two nodes."""
    r = random.Random(6)
    texts = {i: " ".join(f"w{r.randrange(3000)}" for _ in range(30)) for i in range(40)}
    texts |= {100 + i: texts[i] for i in range(10)} | {200 + i: texts[i] + " more" for i in range(10, 20)}
    real = near_copies.set_key
    weak = lambda s, odd=frozenset(), seed=1: real(s, seed=2) if seed == 2 or (real(s) % 11) in odd else real(s) % 11
    monkeypatch.setattr(near_copies, "set_key", weak)
    out = near_copies.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in out.select("doc_id").collect()) == brute_kept(texts)

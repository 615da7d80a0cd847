"""Queries of the catalog against brute force over whole small tables."""

import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import inference
from ledgerlight.functions.text import CLASS_WORDS, MATERIAL_WORDS, STOPWORDS
from ledgerlight.operators import corpus, evaluation
from ledgerlight.plans import corpus_queries
from ledgerlight.plans.catalog_queries import pairs, queries

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


CASCADE = (("material", MATERIAL_WORDS), *CLASS_WORDS)


def kept_by_any_wording(phrase):
    """The words that a rewording must keep: those with the first keyword of the phrase's class, or a budget's numbers."""
    low = phrase.lower()
    if "budget" in low or re.search(r"(\$|<=|under)\s*\d", low):
        return {w for w in tokens(phrase) if re.search("[0-9]", w) or w == "budget"}
    for _, words in CASCADE:
        if first := next((w for w in words if w in low), None):
            return {w for w in tokens(phrase) if first in w}
    return set()


def test_divergence_measures_every_phrase_against_every_document(spark):
    want = {}
    said = {d["doc_id"]: tokens(d["text"]) for d in read(spark, "documents")}
    for b in read(spark, "benchmark"):
        p = tokens(b["text"])
        pinned = kept_by_any_wording(b["text"] or "")
        content, pairs = [w for w in p if w not in STOPWORDS and w not in pinned], {x for x in zip(p, p[1:]) if not set(x) <= set(STOPWORDS)}
        for i, t in said.items():
            ratio, shared = sum(w in set(t) for w in content) / max(1, len(content)), len(pairs & set(zip(t, t[1:])))
            want[b["item_id"], i] = (len(content), round(ratio, 9), shared, ratio == 0 and shared == 0)
    got = queries()["lexical_divergence"](spark, SF).collect()
    assert len(want) == 40 * 200
    alone = {i: sum(v[3] for (item, _), v in want.items() if item == i) for i, _ in want}  # pairs that share nothing, as counts
    assert {(r[0], r[1]): tuple(r[2:-1]) for r in got if r["doc_id"] is not None} == {k: v for k, v in want.items() if not v[3]}
    assert {r["item_id"]: r["documents"] for r in got if r["doc_id"] is None} == {i: n for i, n in alone.items() if n}
    buckets = {r["bucket"]: r for r in queries()["bucket_summary"](spark, SF).collect()}
    for k in range(4):
        part = sorted(v for (item, _), v in want.items() if item % 4 == k)
        assert (buckets[k]["n"], buckets[k]["passed"]) == (len(part), sum(v[3] for v in part))
        assert buckets[k]["mean"] == pytest.approx(sum(v[1] for v in part) / len(part), abs=2e-6)


def test_resampling_draws_all_replicates(spark):
    both = sorted((r.asDict() for r in pairs(spark, SF).collect()), key=lambda r: r["sample_id"])
    n = len(both)

    def mix(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * 73_244_475) & 0xFFFFFFFF
        return x >> 16 ^ x

    draw = lambda rep, i, salt=0: mix(mix(rep + salt) ^ mix(i + (1 << 31)))

    def score(rows):
        h, rr, t = (round(sum(x) / n, 6) for x in zip(*rows, strict=True))
        return round(0.5 * h + 0.3 * rr + 0.2 * max(0, min(1, (11 - t) / 10)), 6)

    some = [draw(rep, i) for rep in range(200) for i in range(500)]  # even, and not alike from one replicate or place to the next
    assert all(abs(sum(x % 10 == k for x in some) / len(some) - 0.1) < 0.005 for k in range(10)) and len(set(some)) > 0.9999 * len(some)
    assert abs(sum((x ^ y).bit_count() for x, y in zip(some, some[1:])) / len(some) - 16) < 0.1 and abs(sum((x ^ y).bit_count() for x, y in zip(some, some[500:])) / len(some[500:]) - 16) < 0.1
    a, b = ([tuple(r[f"{p}_{k}"] for k in ("hit", "rr", "turn")) for r in both] for p in "ab")
    deltas = []
    for rep in range(10_000):
        at = [draw(rep, i) % n for i in range(n)]
        deltas.append(score([b[i] for i in at]) - score([a[i] for i in at]))
    deltas.sort()
    got = queries()["paired_bootstrap"](spark, SF).first()
    assert (got["low"], got["high"]) == pytest.approx((deltas[249], deltas[9750]), abs=2e-6)
    assert got["standard_error"] == pytest.approx(statistics.pstdev(deltas), abs=2e-6)
    observed, extreme = abs(score(b) - score(a)), 0
    for rep in range(10_000):
        swap = [draw(rep, i, 1_000_003) % 2 for i in range(n)]
        x, y = [(b if s else a)[i] for i, s in enumerate(swap)], [(a if s else b)[i] for i, s in enumerate(swap)]
        extreme += abs(score(y) - score(x)) >= observed - 1e-9
    got = queries()["paired_permutation"](spark, SF).first()["p_value"]
    assert got == pytest.approx((extreme + 1) / 10_001, abs=3e-4)


def exact_p(differences):
    """Counts of all sign patterns by sum, as the coefficients of a polynomial packed in one number."""
    bits, observed, total = len(differences) + 1, abs(sum(differences)), sum(map(abs, differences))
    counts = 1
    for d in differences:
        counts += counts << (abs(d) * bits)
    part = (1 << bits) - 1
    chunk = counts.to_bytes((total + 1) * bits // 8 + 1, "little")
    extreme = 0
    for b in range(total + 1):
        if abs(total - 2 * b) >= observed:
            lo = b * bits
            extreme += int.from_bytes(chunk[lo // 8 : (lo + bits) // 8 + 1], "little") >> lo % 8 & part
    return extreme / 2 ** len(differences)


def test_sign_flip_counts_every_session(spark):
    both = pairs(spark, "/root/testdata/sf0.01").collect()
    assert len(both) > 20
    d = [round((r["b_rr"] - r["a_rr"]) * 2520) for r in both]
    got = queries()["sign_flip"](spark, "/root/testdata/sf0.01").first()["p_value"]
    assert got == pytest.approx(exact_p(d), abs=1e-8)
    for few in ([3, -1, 2, 4], [5], [0, 0], [], [1, -1, 2, 2, 7, 7, -3], [2520] * 12):
        counts = {v: few.count(v) for v in few}
        assert inference.sign_flip_lattice(counts) == pytest.approx(inference.exact_sign_flip(few) if few else 1.0, abs=1e-9)


def test_sign_flip_beyond_one_transform(spark):
    """More steps than 2^26, where only the normal approximation is at hand to compare with."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, (F.col("id") % 2500) / 2520).otherwise(-(F.col("id") % 2483) / 2520).alias("d"))
    d = [round(r["d"] * 2520) for r in rows.collect()]
    assert sum(map(abs, d)) > 1 << 26
    z = (abs(sum(d)) - 0.5) / math.sqrt(sum(x * x for x in d))
    got = evaluation.sign_flip_p_of_all(rows, 2520).first()["p_value"]
    assert got == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-4)
    assert evaluation.sign_flip_p_of_all(rows.limit(0), 2520).first()["p_value"] == 1.0
    with pytest.raises(Exception, match="not a multiple"):
        evaluation.sign_flip_p_of_all(spark.createDataFrame([(0.3333,), (0.5,)], "d double"), 2).collect()


def test_mentions_of_several_words_are_found(spark, tmp_path):
    text = "I want Brand 7, not brand 16: LARGE ring"
    spark.createDataFrame([(1, 0, "user", text), (1, 1, "bot", text), (2, 0, "user", "none of it")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("part", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    known = {r["phrase"] for r in queries()["phrase_resolution"](spark, SF).collect()}
    t = tokens(text)
    said = [g for n in range(1, len(t) + 1) for i in range(len(t) - n + 1) if (g := " ".join(t[i : i + n])) in known]
    assert {"brand 7", "brand 16", "large", "ring"} <= set(said)
    assert [tuple(r) for r in queries()["ngram_gazetteer_match"](spark, str(tmp_path)).collect()] == [(1, 0, len(said), len(set(said)))]


def test_phrases_are_accepted_by_rounds_as_one_by_one(spark):
    rows = corpus_queries.wordings(spark, SF).collect()
    by = {(r["item"], r["attempt"]): r for r in rows}
    gates = {(r["item"], r["attempt"]): r["outcome"] for r in corpus.local_gates(corpus_queries.wordings(spark, SF), ["wool", "tone 7"]).collect()}
    pair = {r["item"]: r["pair"] for r in rows}
    left, accepted, want = sorted(pair), set(), {}
    for n in range(3):
        claimed, passed, now = {}, [], {}
        for i in left:
            r = by.get((i, n))
            p = r and r["phrase"]
            if p is None or gates[i, n]:
                now[i] = "no_phrase" if p is None else gates[i, n]
            elif (pair[i], p) in accepted:
                now[i] = "repeated"
            elif (pair[i], p) in claimed:
                now[i] = "claimed"
            else:
                claimed[pair[i], p] = i
                passed.append(i)
        for i in passed:
            now[i] = "accepted" if by[i, n]["faithful"] else "unfaithful"
            if now[i] == "accepted":
                accepted.add((pair[i], by[i, n]["phrase"]))
        want |= {i: (n + 1, now[i]) for i in left}
        left = [i for i in left if now[i] != "accepted"]
    got = {r["item"]: (r["attempts"], r["outcome"]) for r in queries()["phrase_gates"](spark, SF).collect()}
    assert got == want
    assert {o for _, o in want.values()} >= {"accepted", "no_phrase"} and {a for a, _ in want.values()} == {1, 2, 3}


def test_only_phrases_that_pass_claim_their_wording(spark):
    rows = [(1, 1, "red wool", "red wool", "a red wool coat"), (2, 1, "wool", "red wool", "x"), (3, 1, "wool", "red wool", "y"), (4, 2, "wool", "red wool", "z"), (5, 1, "red", None, "x")]
    got = {r["item"]: r["outcome"] for r in corpus.phrase_gate(spark.createDataFrame(rows, "item int, pair int, control string, phrase string, target string"), []).collect()}
    assert got == {1: "too_close", 2: "accepted", 3: "claimed", 4: "accepted", 5: "no_phrase"}

"""Conversations, evaluation and corpora."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import inference as I
from ledgerlight.operators import conversation as C
from ledgerlight.operators import corpus, evaluation
from ledgerlight.operators.order import ranked_rows
from ledgerlight.streaming.sessions import ledger_stream

WORDS = {"red": ("red", "color"), "blue": ("blue", "color"), "boots": ("boots", "category"), "dark red": ("dark red", "color"), "wool": ("wool", "material")}


def told(*messages, asked=None):
    ledger = C.Ledger()
    for t, m in enumerate(messages, 1):
        ledger.apply(C.extract(m, t, asked, WORDS, 2), t)
    return ledger


def test_extraction():
    got = C.extract("I need boots, not wool; dark red under $40", 1, None, WORDS, 2)
    assert [(u.action, u.attribute, u.value, u.excluded, u.strength) for u in got] == [
        ("add", "budget", "40", False, "hard"), ("set", "category", "boots", False, "hard"), ("add", "material", "wool", True, "hard"), ("set", "color", "dark red", False, "soft"),
    ]
    assert C.extract("show me more", 2, None, WORDS, 2) == [] and C.dialogue_act("", None) == "empty"
    assert [u.action for u in C.extract("I don't have a preference for color", 2, "color", WORDS, 2)] == ["decline"]
    assert [(u.action, u.attribute, u.value) for u in C.extract("the snug one", 2, "size", WORDS, 2)] == [("set", "size", "snug one")]
    assert [(u.attribute, u.confidence) for u in C.extract("something nice", 1, None, WORDS, 2)] == [("other", 0.55)]
    assert [(u.action, u.value) for u in C.extract("forget red; i need teal", 1, None, WORDS, 2)] == [("remove", "red"), ("set", "teal")]


def test_ledger():
    active = lambda led: [(c["attribute"], c["value"]) for c in led.active()]
    led = told("red", "blue")
    assert active(led) == [("color", "blue")] and led.constraints[0]["status"] == "superseded" and led.version == 2
    assert told("red", "red").version == 1
    assert active(told("red", "actually, wool")) == [("color", "red"), ("material", "wool")]
    assert active(told("red", "actually, blue")) == [("color", "blue")]
    assert active(told("red", "forget red")) == []
    assert led.active()[0]["id"] == "t2:color:equals:blue:include:2"


def test_replay_and_stream_agree(spark, tmp_path):
    r = random.Random(0)
    said = ["red", "blue boots", "actually, wool", "forget red", "no wool", "under $30", "next", ""]
    rows = [(s, t, r.choice(said), None) for s in range(8) for t in range(1, 6)]
    schema = "session long, turn int, text string, asked string"
    batch = C.replay(spark.createDataFrame(rows, schema).repartition(3), WORDS)
    want = sorted(map(str, batch.collect()))
    for i, turns in enumerate(([1, 2], [3], [4, 5])):
        spark.createDataFrame([x for x in rows if x[1] in turns], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ledger_stream(stream, WORDS).writeStream.format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(map(str, spark.table("ledger").collect())) == want


def test_simulated_customer():
    card = {"hard_constraints": ["red", "wool"], "soft_preferences": ["zip"]}
    assert C.initial_message("buying", "boots", card)[1] == ["red"]
    assert C.customer_reply("boundary", "color", card, set(), False, str)[2] is True
    assert C.customer_reply("buying", "other", card, {"red"}, False, str)[1] == ["wool", "zip"]


def sessions(spark, hits):
    rows = [(str(i), h is not None, h, None if h is None else 1 + i % 3, 0.0 if h is None else 1 / (1 + i % 3)) for i, h in enumerate(hits)]
    return spark.createDataFrame(rows, "sample_id string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")


def test_metrics(spark):
    s = sessions(spark, [1, None, 3, 2])
    got = evaluation.metric_summary(s).first()
    assert (got["hit_rate"], got["mttc"]) == (0.75, 4.25)
    assert got["technical_score"] == pytest.approx(0.5 * 0.75 + 0.3 * got["mrr"] + 0.2 * 0.675)
    assert {r["depth"]: r["hit_rate"] for r in evaluation.hit_rate_curve(s).collect()} == {1: 0.5, 3: 0.75, 5: 0.75, 10: 0.75}
    assert evaluation.outcome_violations(s).count() == 0
    assert evaluation.outcome_violations(s.withColumn("best_rank", F.lit(11))).count() > 0


def test_paired_inference(spark):
    a, b = sessions(spark, [1, None, 3, 2, None, 4]), sessions(spark, [1, 2, 3, 2, 5, None])
    same = evaluation.paired(a, a)
    out = evaluation.bootstrap_interval(evaluation.bootstrap_replicates(same, 40), 40).first()
    assert (out["low"], out["high"], out["standard_error"]) == (0.0, 0.0, 0.0)
    assert evaluation.permutation_p(evaluation.permutation_replicates(same, 40), 0.0).first()["p_value"] == 1.0
    counts = evaluation.mcnemar_counts(evaluation.paired(a, b)).first()
    assert (counts["b"], counts["c"]) == (1, 2)
    with pytest.raises(Exception, match="unpaired"):
        evaluation.paired(a, b.limit(3)).collect()
    d = [0.3, -0.1, 0.25, 0.4]
    got = evaluation.sign_flip_p(spark.createDataFrame(list(enumerate(d)), "pos long, d double"), 4).first()["p_value"]
    assert got == pytest.approx(I.exact_sign_flip(d))


def test_formulas(spark):
    assert I.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    assert {r["name"]: round(r["holm_p"], 9) for r in evaluation.holm_adjust(tests).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert [I.percentile_indices(r) for r in (40, 200, 500, 10_000)] == [(0, 39), (4, 195), (11, 488), (249, 9750)]
    assert I.mcnemar_exact(5, 5) == I.mcnemar_exact(0, 0) == 1.0
    assert I.binomial_standard_error(0.9, 10) == pytest.approx(0.094868, abs=1e-6)
    assert I.expected_max_of_k(1) == 0.0 and I.expected_max_of_k(2) == pytest.approx(0.5641895835, abs=1e-9)
    assert I.classify_verdict(0.01, 0.1, 0.05, ()) == "win" and I.classify_verdict(0.5, 0.01, 0.05, ("x",)) == "not detectable"
    assert I.classify_verdict(0.01, 0.1, 0.05, ("x",)) == "significant, below ship bar" and I.classify_verdict(0.5, 0.1, 0.05, ("x",)) == "no difference"
    assert I.failed_criteria(0.01, 0.02, 0.0, 0.0, 0.0) == () and I.failed_criteria(0.2, 0.0, -0.1, 0.01, -1.0) == I.CRITERIA
    assert I.failed_criteria(0.01, 0.02, -0.01, 0.1, -1.0) == ()
    rounded = spark.createDataFrame([(v,) for v in (0.1234565, 0.0000005, 0.0078125, 2.5, 1234.5678905)], "v double").select("v", evaluation.round6(F.col("v")).alias("r"))
    assert all(r["r"] == round(r["v"], 6) for r in rounded.collect())
    arms = [("a", "f1", 0.05, 0.005, 0.001, 0.1, 0.0, 0.0), ("b", "f0", 0.05, 0.02, 0.4, 0.0, 0.0, 0.0), ("c", "f2", 0.03, 0.001, 0.002, -0.1, 0.01, 1.0)]
    judged = evaluation.adjudicate(spark.createDataFrame(arms, "name string, fingerprint string, delta double, standard_error double, p_value double, hit_rate_delta double, mrr_delta double, mttc_delta double"), 3)
    got = {r["name"]: r for r in judged.collect()}
    holm = dict(zip("abc", I.holm([0.001, 0.4, 0.002])))
    for name, _, delta, se, _, *moved in arms:
        corrected = delta - I.winners_curse_correction(se, 3)
        failed = I.failed_criteria(holm[name], corrected, *moved)
        assert tuple(got[name]["failed_criteria"]) == failed and got[name]["corrected_delta"] == pytest.approx(corrected)
        assert got[name]["verdict"] == I.classify_verdict(holm[name], delta, I.minimum_detectable_difference(se), failed)
    assert [n for n, r in got.items() if r["is_champion"]] == ["b"]


def test_corpus_operators(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, size long")
    assert {r["stratum"]: r["quota"] for r in corpus.proportional_quotas(sizes, 7).collect()} == {"a": 4, "b": 2, "c": 1}
    rows = spark.createDataFrame([(1, 1, "red wool", "red wool", "a red wool coat"), (2, 1, "red", "scarlet red", "a coat"), (3, 1, "red", "red zip tab", "x")], "item int, pair int, control string, phrase string, target string")
    got = {r["item"]: r["outcome"] for r in corpus.phrase_gate(rows, ["zip"]).collect()}
    assert got == {1: "too_close", 2: "accepted", 3: "contradicts"}
    pairs = spark.createDataFrame([(1, "control", "x"), (1, "probe", "x"), (2, "probe", "y"), (3, "control", "z"), (3, "probe", "w")], "pair int, arm string, target string")
    assert {(r["pair"], r["violation"]) for r in corpus.pairing_violations(pairs).collect()} == {(2, "no_control"), (2, "single_arm"), (3, "several_targets")}


def test_places_are_whole_where_ranges_follow_from_a_sample(spark):
    rows = spark.range(0, 60_000, 1, 6).select(F.xxhash64("id").alias("key"), "id", F.repeat(F.lit("x"), F.lit(20)).alias("more"))
    got = ranked_rows(rows, "key", name="k").agg(F.min("k"), F.max("k"), F.count_distinct("k")).first()
    assert tuple(got) == (0, 59_999, 60_000)
    right = spark.range(0, 60_000).select(F.xxhash64("id").alias("key")).toPandas()["key"].sort_values().tolist()
    assert [r["key"] for r in ranked_rows(rows, "key", name="k").orderBy("k").select("key").collect()] == right
    some = spark.createDataFrame([(None,), (2,), (1,)], "key long")
    assert {r["key"]: r["k"] for r in ranked_rows(some, "key", name="k", nulls_first=False).collect()} == {1: 0, 2: 1, None: 2}

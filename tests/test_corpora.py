"""Profiles, rules of corpus rows against a plain reading of each row, and the registry with two writers."""

import collections
import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import corpus
from ledgerlight.operators import profiles as P
from ledgerlight.plans import corpus_queries
from ledgerlight.plans.catalog_queries import queries
from ledgerlight.sources import files, registry
from ledgerlight.sources import lines as lines_module
from ledgerlight.sources.schemas import OUTCOME

SF = "/root/testdata/sf0.001"


def blank(x):
    return not (x or "").strip(" ")


def broken(r):
    card, user, behavior = r["intent_card"], r["user_profile"], r["behavior"]
    hard, soft, over, out = card["hard_constraints"], card["soft_preferences"], behavior["override"], set()
    add = lambda name, wrong: out.add(name) if wrong else None
    add("no_sample_id", blank(r["sample_id"]))
    add("unknown_scenario", r["scenario_type"] not in P.SCENARIOS)
    add("no_category", blank(r["category_bucket"]))
    add("wrong_difficulty", r["scenario_type"] in P.SCENARIOS and r["difficulty_bucket"] != P.DIFFICULTY[r["scenario_type"]])
    add("no_target", blank(r["ground_truth"]["parent_asin"]))
    add("unknown_arm", r["arm"] not in P.ARMS)
    add("malformed_pair_id", not re.fullmatch(P.PAIR_ID[1:-1], r["pair_id"] or ""))
    add("sample_id_of_another_pair", r["sample_id"] != f"{r['pair_id']}_{r['arm']}")
    add("scenarios_differ", behavior["scenario_type"] != r["scenario_type"])
    wanted = behavior["scenario_type"] == "intent_override"
    add("override_missing", wanted and over is None)
    add("override_without_scenario", not wanted and over is not None)
    if over is not None:
        add("override_turn_out_of_range", not 2 <= over["turn"] <= 10)
        add("override_blank", any(blank(over[k]) for k in ("old_value", "new_value", "message")))
        add("override_value_not_in_card", over["new_value"] not in [*(hard or []), *(soft or [])])
    add("no_target_category", blank(card["target_category"]))
    add("target_category_too_long", len(card["target_category"] or "") > 180)
    both = [*(hard or []), *(soft or [])]
    add("repeated_constraint", len(both) != len(set(both)))
    add("rating_out_of_range", user["average_prior_rating"] is not None and not 0 <= user["average_prior_rating"] <= 5)
    add("no_tags", user["preference_tags"] is None)
    add("blank_tag", any(blank(t) for t in user["preference_tags"] or []))
    add("blank_profile", any(blank(user[k]) for k in ("purchase_frequency", "rating_style", "summary")))
    for name, values in (("hard", hard), ("soft", soft)):
        add(f"no_{name}_values", not values)
        add(f"blank_{name}_value", any(blank(v) for v in values or []))
        add(f"untrimmed_{name}_value", any(v.strip(" ") != v for v in values or []))
        add(f"{name}_value_too_long", any(len(v) > 180 for v in values or []))
    return out


def test_every_rule_is_broken_somewhere_and_found(spark):
    rows = corpus_queries.corpus_rows(spark, SF).collect()
    want = collections.Counter((r["sample_id"], v) for r in rows for v in broken(r))
    times = collections.Counter(r["sample_id"] for r in rows)
    want.update((i, "repeated_sample_id") for i, n in times.items() if n > 1)
    got = collections.Counter(map(tuple, queries()["corpus_violations"](spark, SF).collect()))
    assert got == want
    assert {v for _, v in want} == {*P.corpus_rules(), "repeated_sample_id"}
    assert P.corpus_violations(corpus_queries.corpus_rows(spark, SF, spoiled=False)).count() == 0


def test_profiles_follow_their_weights_and_content(spark):
    pairs = spark.range(4000).select(F.col("id").cast("string").alias("target"), P.pair_id(P.corpus_stem(F.lit("probe.v1")), F.col("id")).alias("pair_id"))
    got = {r["target"]: r["user_profile"] for r in P.profile_draws(pairs).collect()}
    n = len(got)
    tags = collections.Counter(len(p["preference_tags"]) for p in got.values())
    assert all(abs(tags[k] / n - w / 200) < 0.03 for k, w in P.TAG_COUNTS)
    firsts, total = collections.Counter(p["preference_tags"][0] for p in got.values()), sum(w for _, w in P.TAGS)
    assert all(abs(firsts[t] / n - w / total) < 0.03 for t, w in P.TAGS)
    assert all(len(set(p["preference_tags"])) == len(p["preference_tags"]) for p in got.values())
    assert {(p["rating_style"], p["average_prior_rating"]) for p in got.values()} == {(s, r) for s, r, _ in P.RATINGS}
    again = {r["target"]: r["user_profile"] for r in P.profile_draws(pairs.orderBy(F.col("target").desc()).limit(50)).collect()}
    assert again == {t: got[t] for t in again}
    seed = hashlib.sha256(f"7\0probe_v1_0007\0{P.PROFILE_LABEL}".encode()).hexdigest()
    at = {t: -math.log((int(hashlib.sha256(f"{seed}\0{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for t, w in P.TAGS}
    assert got["7"]["preference_tags"] == sorted(at, key=at.get)[: len(got["7"]["preference_tags"])]
    for wrong in (P.pair_id(F.lit("a_v1"), F.lit(10_000)), P.corpus_stem(F.lit("probe"))):
        with pytest.raises(Exception, match="pair index|version"):
            spark.range(1).select(wrong).collect()


def test_registry(spark, tmp_path):
    home = f"file://{tmp_path}/registry"
    rows = corpus_queries.corpus_rows(spark, SF, spoiled=False)
    with pytest.raises(ValueError, match="breaks rules"):
        registry.publish(corpus_queries.corpus_rows(spark, SF), home, "parts.v1")
    assert registry.entries(spark, home) == (0, {})  # what was staged is named by no version
    entry = registry.publish(rows, home, "parts.v1")
    assert registry.resolve(spark, home, "parts.v1").count() == rows.count() == entry["rows"]
    with pytest.raises(ValueError, match="frozen"):
        registry.publish(rows.limit(10), home, "parts.v1")
    registry.publish(rows.limit(10), home, "parts.v1", refreeze=True)
    assert registry.resolve(spark, home, "parts.v1").count() == 10 and registry.versions(spark, home) == [1, 2]
    # two writers that have both read version 2
    one, other = entry | {"name": "one.v1"}, entry | {"name": "other.v1"}
    assert registry.commit(spark, home, 2, one) == 3
    with pytest.raises(registry.Conflict):
        registry.commit(spark, home, 2, other)
    real = registry.entries
    registry.entries = lambda *a: (2, {})  # reads before the first has written, writes after
    try:
        with pytest.raises(registry.Conflict, match="by another"):
            registry.commit(spark, home, 2, other)
    finally:
        registry.entries = real
    assert sorted(registry.entries(spark, home)[1]) == ["one.v1", "parts.v1"]
    with pytest.raises(KeyError):
        registry.resolve(spark, home, "other.v1")
    held = registry.entries(spark, home)[1]["parts.v1"]["path"].removeprefix("file://")
    (file,) = [p for p in __import__("pathlib").Path(held).glob("part*") if p.stat().st_size][:1]
    file.write_text(file.read_text().replace("clothing", "closing", 1))
    for p in file.parent.glob(".*.crc"):
        p.unlink()
    with pytest.raises(ValueError, match="has changed"):
        registry.resolve(spark, home, "parts.v1")


def test_bad_lines_are_named_by_file_and_number(spark, tmp_path):
    good = [json.dumps({"sample_id": f"s{i}", "hit": False, "reciprocal_rank": 0.0}) for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(good[:1500]) + "\n\n")
    spoiled = {7: "[1]", 400: "{broken", 900: json.dumps({"hit": True}), 1100: json.dumps({"sample_id": "s3"}), 1499: json.dumps({"sample_id": "x", "hit": "perhaps"})}
    lines = [spoiled.get(i, x) for i, x in enumerate(good[1500:], 1)]
    lines.insert(3, "   ")  # blank lines count as lines
    (tmp_path / "in/b.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several parts to a file
    try:
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["wrong"] for r in lines_module.bad_lines(spark, f"file://{tmp_path}/in", OUTCOME, "sample_id").collect()}
        assert got == {("b.jsonl", 8): "not an object", ("b.jsonl", 401): "malformed", ("b.jsonl", 901): "no sample_id", ("b.jsonl", 1101): "repeated sample_id", ("b.jsonl", 1500): "malformed"}
        with pytest.raises(Exception, match=r"b.jsonl, line \d+: "):
            files.read_sessions(spark, f"file://{tmp_path}/in").collect()
        whole = files.read_sessions(spark, f"file://{tmp_path}/in/a.jsonl")
        assert whole.count() == 1500 and sorted(r["sample_id"] for r in whole.collect()) == sorted(f"s{i}" for i in range(1500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_pair_is_measured_whether_or_not_it_shares_a_word(spark):
    phrases = spark.createDataFrame([(1, "red boots"), (2, "quiet lamp"), (3, None), (None, "red")], "item_id long, phrase string")
    targets = spark.createDataFrame([(10, "red boots for snow"), (11, "a lamp"), (12, None), (None, "lamp")], "doc_id long, target string")
    got = {(r["item_id"], r["doc_id"]): (r["overlap_ratio"], r["shared_bigrams"], r["passes"]) for r in corpus.divergence_of_pairs(phrases, targets).collect()}
    want = {(i, d): (0.0, 0, True) for i in (1, 2, 3) for d in (10, 11, 12)}
    assert got == want | {(1, 10): (1.0, 1, False), (2, 11): (0.5, 0, False)}

"""Customers' profiles drawn by weight, and the rules that a corpus row with its nested card, behavior and profile must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what profiles are drawn from, with weights
PURCHASE_FREQUENCY = "3-4 prior purchases"
RATINGS = (("critical", 1.0, 14), ("critical", 2.0, 9), ("critical", 3.0, 22), ("mixed", 4.0, 21), ("usually positive", 5.0, 134))
TAGS = (("comfort", 144), ("durability", 47), ("fit", 163), ("general shopping", 1), ("material", 154), ("performance", 26), ("style", 101), ("warmth", 18), ("weather", 12))
TAG_COUNTS = ((1, 6), (2, 43), (3, 30), (4, 121))
PROFILE_LABEL = "corpus-user-profile"
# fixed values: what rows are checked by
SCENARIOS = ("boundary", "browsing", "buying", "intent_override")
ARMS = ("control", "probe_haiku", "probe_sonnet")
DIFFICULTY = {"boundary": "medium", "browsing": "medium", "buying": "easy", "intent_override": "hard"}
LONGEST = 180
OVERRIDE_TURNS = (2, 10)
PAIR_ID = r"^[a-z][a-z0-9_]*_v[0-9]+_[0-9]{4}$"


def content_seed(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, joined by NUL: the same for the same content, whatever the rows' order."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def uniform(seed: Column, name: str) -> Column:
    """A number between 0 and 1 for each name under a seed: 52 bits of a SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("\0", seed, F.lit(name)), 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def weighted_choice(u: Column, weights: tuple[int, ...], values: list[Column]) -> Column:
    """The value in whose share of the weights u falls."""
    total, upto, out = sum(weights), 0, F
    for w, v in zip(weights, values, strict=True):
        upto += w
        out = out.when(u * total < upto, v)
    return out


def weighted_sample(seed: Column, items: tuple[tuple[str, int], ...], n: Column) -> Column:
    """n of the items without replacement, by weight, in the order drawn: the n least of the times -ln(u) / weight, which come as one
    draw after another would."""
    timed = F.array(*[F.struct((-F.log(uniform(seed, name)) / float(w)).alias("at"), F.lit(name).alias("name")) for name, w in items])
    return F.transform(F.slice(F.array_sort(timed), 1, n), lambda x: x["name"])


def profile_draws(pairs: DataFrame) -> DataFrame:
    """pairs (target, pair_id) with the profile that both arms of a pair share, seeded by its content."""
    seed = content_seed(F.col("target"), F.col("pair_id"), F.lit(PROFILE_LABEL))
    rating = weighted_choice(uniform(seed, "#rating"), tuple(w for *_, w in RATINGS), [F.struct(F.lit(s).alias("style"), F.lit(r).alias("rating")) for s, r, _ in RATINGS])
    count = weighted_choice(uniform(seed, "#tags"), tuple(w for _, w in TAG_COUNTS), [F.lit(n) for n, _ in TAG_COUNTS])
    rows = pairs.withColumn("_r", rating).withColumn("preference_tags", weighted_sample(seed, TAGS, count))
    summary = F.concat(F.lit("Prior purchases emphasize "), F.array_join("preference_tags", ", "), F.lit("; ratings are "), F.col("_r.style"), F.lit("."))
    profile = F.struct(
        F.lit(PURCHASE_FREQUENCY).alias("purchase_frequency"), F.col("_r.rating").alias("average_prior_rating"), F.col("_r.style").alias("rating_style"), "preference_tags",
        summary.alias("summary"),
    )
    return rows.select(*pairs.columns, profile.alias("user_profile"))


def corpus_stem(name: Column) -> Column:
    """A corpus's name as its rows' ids begin, which needs a version: probe.v1 gives probe_v1."""
    stem = F.replace(name, F.lit("."), F.lit("_"))
    return F.when(F.contains(name, F.lit(".")) & stem.rlike("^[a-z][a-z0-9_]*$"), stem).otherwise(F.raise_error(F.concat(F.lit("not a corpus name with a version: "), name)).cast("string"))


def pair_id(stem: Column, index: Column) -> Column:
    good = index.between(0, 9999)
    return F.when(good, F.concat_ws("_", stem, F.lpad(index.cast("string"), 4, "0"))).otherwise(F.raise_error(F.concat(F.lit("pair index beyond four digits: "), index.cast("string"))).cast("string"))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _some(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def corpus_rules() -> dict[str, Column]:
    """What breaks each rule of a corpus row, by name; paths lead into nested structs and arrays."""
    c = F.col
    hard, soft, tags, over = c("intent_card.hard_constraints"), c("intent_card.soft_preferences"), c("user_profile.preference_tags"), c("behavior.override")
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(hard, none), F.coalesce(soft, none))
    rating, wanted = c("user_profile.average_prior_rating"), c("behavior.scenario_type") == "intent_override"
    difficulty = F.create_map(*[F.lit(x) for pair in DIFFICULTY.items() for x in pair])
    out = {
        "no_sample_id": _blank(c("sample_id")), "unknown_scenario": ~F.coalesce(c("scenario_type").isin(*SCENARIOS), F.lit(False)), "no_category": _blank(c("category_bucket")),
        "wrong_difficulty": c("scenario_type").isin(*SCENARIOS) & ~c("difficulty_bucket").eqNullSafe(difficulty[c("scenario_type")]), "no_target": _blank(c("ground_truth.parent_asin")),
        "unknown_arm": ~F.coalesce(c("arm").isin(*ARMS), F.lit(False)), "malformed_pair_id": ~F.coalesce(c("pair_id").rlike(PAIR_ID), F.lit(False)),
        "sample_id_of_another_pair": ~c("sample_id").eqNullSafe(F.concat_ws("_", "pair_id", "arm")), "scenarios_differ": ~c("behavior.scenario_type").eqNullSafe(c("scenario_type")),
        "override_missing": F.coalesce(wanted, F.lit(False)) & over.isNull(), "override_without_scenario": ~F.coalesce(wanted, F.lit(False)) & over.isNotNull(),
        "override_turn_out_of_range": over.isNotNull() & ~F.coalesce(over["turn"].between(*OVERRIDE_TURNS), F.lit(False)),
        "override_blank": over.isNotNull() & reduce(lambda a, b: a | b, (_blank(over[n]) for n in ("old_value", "new_value", "message"))),
        "override_value_not_in_card": over.isNotNull() & ~F.coalesce(F.array_contains(both, over["new_value"]), F.lit(False)),
        "no_target_category": _blank(c("intent_card.target_category")), "target_category_too_long": F.coalesce(F.length("intent_card.target_category") > LONGEST, F.lit(False)),
        "repeated_constraint": F.size(both) != F.size(F.array_distinct(both)),
        "rating_out_of_range": F.coalesce(~rating.between(0, 5) | F.isnan(rating), F.lit(False)), "no_tags": tags.isNull(), "blank_tag": _some(tags, _blank),
        "blank_profile": reduce(lambda a, b: a | b, (_blank(c(f"user_profile.{n}")) for n in ("purchase_frequency", "rating_style", "summary"))),
    }
    for name, values in (("hard", hard), ("soft", soft)):
        out |= {
            f"no_{name}_values": F.coalesce(F.size(values), F.lit(0)) < 1, f"blank_{name}_value": _some(values, _blank),
            f"untrimmed_{name}_value": _some(values, lambda v: F.trim(v) != v), f"{name}_value_too_long": _some(values, lambda v: F.length(v) > LONGEST),
        }
    return out


def corpus_violations(rows: DataFrame) -> DataFrame:
    """sample_id, violation: every rule that a row breaks, from one pass; and ids that several rows bear."""
    found = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in corpus_rules().items()]), lambda x: x.isNotNull())
    twice = rows.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("repeated_sample_id").alias("violation"))
    return rows.select("sample_id", F.explode(found).alias("violation")).unionByName(twice)

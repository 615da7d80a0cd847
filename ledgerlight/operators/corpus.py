"""Building and checking evaluation corpora: strata, quotas, wording distance, and data-quality queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, bigrams, classify_constraint, content_tokens, let, ordered_tokens, pinned_tokens
from .order import ranked_rows
from .state import kept

SCENARIO_MIX = {"boundary": 0.05, "browsing": 0.40, "buying": 0.40, "intent_override": 0.15}
TOLERANCE = 0.02


def price_band(price: Column) -> Column:
    return F.when(price.isNull(), "unknown").when(price < 20, "under_20").when(price < 50, "under_50").when(price < 100, "under_100").otherwise("over_100")


def seeded(label: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(label), key.cast("string")))


def proportional_quotas(sizes: DataFrame, total: int, key: str = "stratum") -> DataFrame:
    """stratum, quota: shares by size, the largest remainders rounded up, ties by name. One row for each stratum."""
    every = Window.partitionBy(F.lit(1))
    n = F.sum("size").over(every)
    rows = sizes.withColumn("_n", n).withColumn("_want", F.least(F.lit(total), F.col("_n")) * F.col("size"))
    rows = rows.withColumn("_floor", F.floor(F.col("_want") / F.col("_n"))).withColumn("_rest", F.col("_want") % F.col("_n"))
    left = F.least(F.lit(total), F.col("_n")) - F.sum("_floor").over(every)
    nth = F.row_number().over(Window.orderBy(F.col("_rest").desc(), key))
    rows = rows.withColumn("_left", left).withColumn("_nth", nth)
    return rows.select(key, "size", (F.col("_floor") + F.when(F.col("_nth") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified_sample(rows: DataFrame, total: int, label: str, key: str, stratum: str = "stratum", excluded: DataFrame | None = None) -> DataFrame:
    """total rows without replacement, each stratum by its share, in the order of a seeded hash of the key."""
    if excluded is not None:
        rows = rows.join(excluded, key, "left_anti")
    quotas = proportional_quotas(rows.groupBy(stratum).agg(F.count("*").alias("size")), total, stratum)
    # a stratum's first rows by hash: those under a threshold that all but surely leaves enough; only they are ranked
    near = quotas.select(stratum, "quota", "size")
    share = F.least(F.lit(1.0), (F.col("quota") + 6 * F.sqrt(F.col("quota") + 1.0) + 20) / F.col("size"))
    drawn = F.conv(F.substring(seeded(label, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    few = rows.join(F.broadcast(near), stratum).where(drawn <= share)
    w = Window.partitionBy(stratum).orderBy(seeded(label, F.col(key)), key)
    held = F.count("*").over(Window.partitionBy(stratum))
    short = F.raise_error(F.lit("a stratum's threshold left too few rows")).cast("int")
    picked = few.withColumn("_nth", F.row_number().over(w)).withColumn("_nth", F.when(held >= F.col("quota"), F.col("_nth")).otherwise(short))
    return picked.where(F.col("_nth") <= F.col("quota")).drop("_nth", "quota", "size")


def assign_by_quota(rows: DataFrame, shares: dict[str, float], label: str, key: str, name: str = "scenario") -> DataFrame:
    """A label for each row, as many of each as its share asks for, dealt in the order of a seeded hash."""
    spark = rows.sparkSession
    n = rows.count()
    sizes = spark.createDataFrame([(k, round(v * 10_000)) for k, v in shares.items()], f"{name} string, size bigint")
    every = Window.partitionBy(F.lit(1))
    q = sizes.withColumn("_t", F.sum("size").over(every)).withColumn("_w", F.lit(n) * F.col("size"))
    q = q.withColumn("_f", F.floor(F.col("_w") / F.col("_t"))).withColumn("_r", F.col("_w") % F.col("_t"))
    q = q.withColumn("_x", F.row_number().over(Window.orderBy(F.col("_r").desc(), name))).withColumn("_l", F.lit(n) - F.sum("_f").over(every))
    q = q.select(name, (F.col("_f") + F.when(F.col("_x") <= F.col("_l"), 1).otherwise(0)).alias("quota"))
    end = F.sum("quota").over(Window.orderBy(name))
    q = q.withColumn("_end", end).withColumn("_start", end - F.col("quota"))
    placed = ranked_rows(rows.withColumn("_seed", seeded(label, F.col(key))), "_seed", key, name="_at").drop("_seed")
    return placed.join(F.broadcast(q), (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))).drop("_at", "_end", "_start", "quota")


def divergence(pairs: DataFrame, phrase: str = "phrase", target: str = "target") -> DataFrame:
    """pairs with the phrase's content tokens (without stop words and those that any wording must keep), the share that the
    target has too, shared word pairs, and whether it passes: nothing shared."""
    p, t = ordered_tokens(F.col(phrase)), ordered_tokens(F.col(target))
    content = let(pinned_tokens(F.col(phrase)), lambda pins: content_tokens(p, pins))
    shared = F.filter(F.array_intersect(bigrams(p), bigrams(t)), lambda b: F.exists(F.split(b, " "), lambda x: ~x.isin(STOPWORDS)))
    both = let(
        F.struct(content.alias("c"), F.array_distinct(t).alias("t"), shared.alias("shared")),
        lambda s: F.struct(F.filter(s["c"], lambda x: F.array_contains(s["t"], x)).alias("overlapping"), s["shared"].alias("shared_bigrams"), F.size(s["c"]).alias("content_tokens")),
    )
    rows = pairs.withColumn("_m", both).select("*", "_m.*").drop("_m")
    ratio = F.when(F.col("content_tokens") == 0, F.lit(0.0)).otherwise(F.size("overlapping") / F.col("content_tokens"))
    rows = rows.withColumn("overlap_ratio", ratio)
    return rows.withColumn("passes", (F.size("overlapping") == 0) & (F.size("shared_bigrams") == 0))


def divergence_of_all(phrases: DataFrame, targets: DataFrame) -> DataFrame:
    """Every phrase (item_id, phrase) measured against every target (doc_id, target), as divergence does: a row for each pair that
    shares something, and for each phrase a row without doc_id that counts the targets (documents) it shares nothing with.

    Words and word pairs of phrases and targets meet in one join, counts are added up before they are shuffled; nothing is
    gathered, and Spark sends the phrases' side to every task only where it is small.
    """
    phrase = F.coalesce("phrase", F.lit(""))
    chosen = phrases.where("item_id is not null").select("item_id", ordered_tokens(phrase).alias("p"), let(pinned_tokens(phrase), lambda pins: content_tokens(ordered_tokens(phrase), pins)).alias("c"))
    size = F.size("c").alias("content_tokens")
    worded = chosen.select("item_id", size, F.explode("c").alias("feature")).groupBy("item_id", "content_tokens", "feature").agg(F.count("*").alias("overlap")).withColumn("shared", F.lit(0))
    doubles = F.filter(bigrams(F.col("p")), lambda b: F.exists(F.split(b, " "), lambda x: ~x.isin(STOPWORDS)))
    index = worded.unionByName(chosen.select("item_id", size, F.explode(doubles).alias("feature"), F.lit(0).cast("bigint").alias("overlap"), F.lit(1).alias("shared")))
    words = targets.where("doc_id is not null").select("doc_id", ordered_tokens(F.coalesce("target", F.lit(""))).alias("t"))
    features = words.select("doc_id", F.explode(F.concat(F.array_distinct("t"), bigrams(F.col("t")))).alias("feature"))
    met = features.join(index, "feature").groupBy("item_id", "doc_id", "content_tokens").agg(F.sum("overlap").alias("overlap"), F.sum("shared").cast("int").alias("shared_bigrams"))
    some = met.select(
        "item_id", "doc_id", "content_tokens", (F.col("overlap") / F.greatest("content_tokens", F.lit(1))).alias("overlap_ratio"), "shared_bigrams",
        F.lit(False).alias("passes"), F.lit(1).cast("bigint").alias("documents"),
    )
    total = targets.where("doc_id is not null").agg(F.count("*")).scalar()
    none = chosen.select("item_id", size).join(some.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left")
    none = none.select(
        "item_id", F.lit(None).cast("bigint").alias("doc_id"), "content_tokens", F.lit(0.0).alias("overlap_ratio"), F.lit(0).alias("shared_bigrams"), F.lit(True).alias("passes"),
        (total - F.coalesce("n", F.lit(0))).alias("documents"),
    )
    return some.unionByName(none.where("documents > 0"))


def divergence_of_pairs(phrases: DataFrame, targets: DataFrame) -> DataFrame:
    """divergence_of_all with a row for every pair of a phrase and a target, those that share nothing included.

    What pairs share is found by the join of words; the pairs themselves go by the phrases' side, which Spark sends to every task
    where it is small."""
    every = divergence_of_all(phrases, targets).where("doc_id is not null")
    size = F.size(let(pinned_tokens(F.coalesce("phrase", F.lit(""))), lambda pins: content_tokens(ordered_tokens(F.coalesce("phrase", F.lit(""))), pins))).alias("content_tokens")
    pairs = targets.where("doc_id is not null").select("doc_id").crossJoin(phrases.where("item_id is not null").select("item_id", size))
    rows = pairs.join(every.drop("content_tokens", "passes", "documents"), ["item_id", "doc_id"], "left")
    ratio, shared = F.coalesce("overlap_ratio", F.lit(0.0)), F.coalesce("shared_bigrams", F.lit(0))
    return rows.select("item_id", "doc_id", "content_tokens", ratio.alias("overlap_ratio"), shared.alias("shared_bigrams"), ((ratio == 0) & (shared == 0)).alias("passes"))


def bucket_summary(reports: DataFrame, bucket: str = "bucket", times: str = "documents") -> DataFrame:
    """Of each bucket's reports, which count several times: number, mean, median and least overlap, and how many pass."""
    n = F.sum(times)
    return reports.groupBy(bucket).agg(
        n.alias("n"), (F.sum(F.col("overlap_ratio") * F.col(times)) / n).alias("mean"), F.percentile("overlap_ratio", F.lit(0.5), F.col(times)).alias("median"),
        F.min("overlap_ratio").alias("least"), F.coalesce(F.sum(F.when(F.col("passes"), F.col(times))), F.lit(0)).alias("passed"),
    )


def preserves_bucket(control: Column, probe: Column) -> Column:
    return classify_constraint(control) == classify_constraint(probe)


def contradicts(phrase: Column, target: Column, vocabulary: list[str]) -> Column:
    known = F.array(*[F.lit(v) for v in vocabulary])
    return F.exists(known, lambda v: F.contains(phrase, v) & ~F.contains(target, v))


ATTEMPTS = 3
LONGEST = 180


def local_gates(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """rows (control, phrase, target) with the first gate that a phrase fails by itself, else null."""
    rows = divergence(rows)
    phrase = F.col("phrase")
    gate = (
        F.when(phrase.isNull(), "no_phrase").when((phrase == "") | (F.trim(phrase) != phrase), "empty_or_untrimmed").when(F.length(phrase) > LONGEST, "too_long")
        .when(~preserves_bucket(F.col("control"), phrase), "bucket_changed").when(~F.col("passes"), "too_close")
        .when(contradicts(phrase, F.col("target"), vocabulary), "contradicts")
    )
    return rows.withColumn("outcome", gate)


def phrase_gate(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """rows (item, pair, control, phrase, target) with the first gate that each phrase fails, or "accepted".

    A phrase that passes alone claims its wording for its pair; the smallest item that does so keeps it."""
    rows = local_gates(rows, vocabulary).withColumn("_passed", F.col("outcome").isNull())
    claim = F.row_number().over(Window.partitionBy("pair", "phrase", "_passed").orderBy("item"))
    return rows.withColumn("outcome", F.when(~F.col("_passed"), F.col("outcome")).when(claim > 1, "claimed").otherwise("accepted")).drop("_passed")


def phrase_rounds(attempts: DataFrame, vocabulary: list[str], cap: int = ATTEMPTS) -> DataFrame:
    """item, pair, attempts, phrase, outcome: what became of each item in at most cap rounds of writing and review.

    attempts: item, pair, control, target, attempt (from 0), phrase, faithful (the review's verdict). In a round every item still
    open sends its phrase for that attempt. One that an accepted phrase of an earlier round words alike is repeated; of those
    that pass, the smallest item claims a wording, whether or not its review then accepts it. Only accepted phrases bind later
    rounds. Items of a round are dealt by pair and wording; a round's outcomes are checkpointed.
    """
    gated = kept(local_gates(attempts, vocabulary).select("item", "pair", "attempt", "phrase", "faithful", F.col("outcome").alias("alone")))
    left = gated.select("item", "pair").distinct()
    done, won = None, None
    for n in range(cap):
        sent = left.join(gated.where(F.col("attempt") == n).drop("pair", "attempt"), "item", "left")
        sent = sent.withColumn("alone", F.when(F.col("phrase").isNull(), "no_phrase").otherwise(F.col("alone")))
        if won is None:
            sent = sent.withColumn("taken", F.lit(False))
        else:
            sent = sent.join(won.withColumn("taken", F.lit(True)), ["pair", "phrase"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        sent = sent.withColumn("open", F.col("alone").isNull() & ~F.col("taken"))
        claim = F.row_number().over(Window.partitionBy("pair", "phrase", "open").orderBy("item"))
        outcome = (
            F.when(F.col("alone").isNotNull(), F.col("alone")).when(F.col("taken"), "repeated").when(claim > 1, "claimed")
            .when(F.coalesce("faithful", F.lit(False)), "accepted").otherwise("unfaithful")
        )
        now = kept(sent.select("item", "pair", F.lit(n + 1).alias("attempts"), "phrase", outcome.alias("outcome")))
        over = now if n == cap - 1 else now.where("outcome = 'accepted'")
        done = over if done is None else done.unionByName(over)
        fresh = now.where("outcome = 'accepted'").select("pair", "phrase")
        won = fresh if won is None else won.unionByName(fresh)
        left = now.where("outcome != 'accepted'").select("item", "pair")
    return done


def surviving_positions(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows (pair, slot, position, item) without the dropped items, positions numbered anew from 0."""
    kept = rows.join(dropped, "item", "left_anti")
    return kept.withColumn("new_position", F.row_number().over(Window.partitionBy("pair", "slot").orderBy("position")) - 1)


# ---- checks: rows that break a rule ----


def scenario_mix_violations(rows: DataFrame, mix: dict[str, float] | None = None, by: str = "scenario") -> DataFrame:
    """scenario, share, wanted of those off by more than the tolerance; scenarios without rows count as 0."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list((mix or SCENARIO_MIX).items()), f"{by} string, wanted double")
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    out = wanted.join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_t"))))
    return out.withColumn("share", F.col("n") / F.col("_t")).where(F.abs(F.col("share") - F.col("wanted")) > TOLERANCE).select(by, "share", "wanted")


def pairing_violations(rows: DataFrame, pair: str = "pair", arm: str = "arm", target: str = "target", control: str = "control") -> DataFrame:
    """pair, violation: no control, fewer than two arms, an arm twice, or different targets."""
    per = rows.groupBy(pair).agg(
        F.count("*").alias("n"), F.countDistinct(arm).alias("arms"), F.countDistinct(target).alias("targets"), F.sum((F.col(arm) == control).cast("bigint")).alias("controls")
    )
    found = F.array(
        F.when(F.col("controls") == 0, F.lit("no_control")), F.when(F.col("arms") < 2, F.lit("single_arm")), F.when(F.col("n") > F.col("arms"), F.lit("repeated_arm")),
        F.when(F.col("targets") > 1, F.lit("several_targets")),
    )
    return per.select(pair, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unmatched_sets(rows: DataFrame, pair: str = "pair", arm: str = "arm", item: str = "item") -> DataFrame:
    """Pairs whose arms do not have the same items: an item that some arm of the pair lacks."""
    arms = rows.select(pair, arm).distinct().groupBy(pair).agg(F.count("*").alias("arms"))
    items = rows.select(pair, arm, item).distinct().groupBy(pair, item).agg(F.count("*").alias("held"))
    return items.join(arms, pair).where("held < arms").select(pair).distinct()


def reconcile(left: DataFrame, right: DataFrame, key: str, n_left: str = "n_left", n_right: str = "n_right") -> DataFrame:
    """Keys whose counts differ between a ledger and the rows it describes."""
    both = left.join(right, key, "full_outer").select(key, F.coalesce(n_left, F.lit(0)).alias(n_left), F.coalesce(n_right, F.lit(0)).alias(n_right))
    return both.where(F.col(n_left) != F.col(n_right))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def describe(rows: DataFrame, pair: str = "pair", arm: str = "arm", target: str = "target") -> DataFrame:
    return rows.agg(F.count("*").alias("sessions"), F.countDistinct(target).alias("targets"), F.countDistinct(pair).alias("pairs"), F.countDistinct(arm).alias("arms"))


def stratum(categories: Column, price: Column) -> Column:
    """department|price band, the department being the second category, else the first."""
    names = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    department = F.coalesce(F.get(names, F.lit(1)), F.get(names, F.lit(0)), F.lit("unknown"))
    return F.concat_ws("|", F.lower(department), price_band(price))


def override_turn(pair: Column, scenario: Column) -> Column:
    """3 or 4, by a draw from the pair and the scenario alone, so that both arms of a pair agree."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit("turn"), pair.cast("string"), scenario)), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % 2 + 3).cast("int")


def cross_check_violations(rows: DataFrame, pair: str, arm: str, checked: str, against: str) -> DataFrame:
    """pair, violation: checked without the arm that it is checked against, or not exactly three rows."""
    per = rows.groupBy(pair).agg(F.count("*").alias("n"), F.bool_or(F.col(arm) == checked).alias("_c"), F.bool_or(F.col(arm) == against).alias("_a"))
    found = F.array(F.when(~F.col("_a"), F.lit("orphan")), F.when(F.col("n") != 3, F.lit("not_three_rows")))
    return per.where("_c").select(pair, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def drop_summary(constraints: DataFrame, pairs: DataFrame, item: str = "item_id", pair: str = "pair_id") -> DataFrame:
    """One row: dropped rows, distinct dropped constraints, refused pairs; a pair refused twice is an error."""
    twice = pairs.groupBy(pair).count().where("count > 1").agg(F.first(pair).cast("string").alias("_twice"))
    dropped = constraints.agg(F.count("*").alias("dropped_constraint_rows"), F.countDistinct(item).alias("dropped_constraints"))
    fail = F.raise_error(F.concat(F.lit("refused twice: "), F.col("_twice"))).cast("bigint")
    out = dropped.crossJoin(pairs.agg(F.count("*").alias("refused_pairs"))).crossJoin(twice)  # a row each
    return out.withColumn("refused_pairs", F.when(F.col("_twice").isNull(), F.col("refused_pairs")).otherwise(fail)).drop("_twice")


def constraints_per_pair(rows: DataFrame, pair: str = "pair", slot: str = "slot", position: str = "position") -> DataFrame:
    return rows.groupBy(pair).agg(F.countDistinct(F.struct(slot, position)).alias("constraints"))


def exclusions(*targets: DataFrame, key: str) -> DataFrame:
    """The ids that any of several corpora uses as targets."""
    out = targets[0].select(key)
    for t in targets[1:]:
        out = out.union(t.select(key))
    return out.where(F.col(key).isNotNull()).distinct()


def several_models(records: DataFrame, by: str, model: str = "model") -> DataFrame:
    """Groups whose records were not made by one model, with the models in order."""
    out = records.groupBy(by).agg(F.array_sort(F.collect_set(model)).alias("models"))
    return out.where(F.size("models") != 1)


MATERIALS = "cotton polyester nylon leather wool spandex silk rayon fabric"  # fixed values, in words
COLORS = "black white blue red pink green brown gray grey purple yellow orange"


def clean_constraint(value: Column, limit: int = 180) -> Column:
    squeezed = F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" -;,.\t\n"))
    return F.rtrim(F.substring(squeezed, 1, limit))


def intent_card(title: Column, features: Column, details: Column, text: Column, price: Column, limit: int = 180) -> Column:
    """struct<target_category,hard_constraints,soft_preferences> of a product: the first material and color that its text
    names, its features, its details as "key: value", its price; cleaned, each once."""
    named = lambda words: F.lower(F.regexp_extract(text, rf"(?i)\b({words.replace(' ', '|')})\b", 1))
    material, color = named(MATERIALS), named(COLORS)
    own = F.concat(F.coalesce(features, F.array().cast("array<string>")), F.coalesce(F.transform(F.filter(details, lambda d: d["value"] != ""), lambda d: F.concat(d["key"], F.lit(": "), d["value"])), F.array().cast("array<string>")))
    tint = F.when(color != "", F.concat(F.lit("color: "), color))
    head = F.slice(own, 1, 1)
    # the material comes first; the color second, or after the first of the product's own where there is no material
    candidates = F.when(material != "", F.concat(F.array(material, tint), own)).otherwise(F.concat(head, F.array(tint), F.slice(own, 2, 10_000)))
    paid = F.when(price.isNotNull(), F.concat(F.lit("budget around $"), price.cast("string")))
    kept = F.transform(F.filter(F.concat(candidates, F.array(paid)), lambda x: x.isNotNull()), lambda x: clean_constraint(x, limit))

    def card(found: Column) -> Column:
        soft = F.slice(found, 3, 2)
        return F.struct(
            clean_constraint(F.coalesce(F.nullif(title, F.lit("")), F.lit("product")), limit).alias("target_category"), F.slice(found, 1, 2).alias("hard_constraints"),
            F.when(F.size(soft) > 0, soft).otherwise(F.slice(found, 1, 1)).alias("soft_preferences"),
        )

    found = F.array_distinct(F.filter(kept, lambda x: x != ""))
    fallback = F.array(clean_constraint(F.coalesce(F.nullif(title, F.lit("")), F.lit("product")), limit))
    return let(let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(fallback)), card)


def target_gist(pairs: DataFrame, vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """id, attribute, value: the distinct pairs of each target that the closed vocabulary admits."""
    return pairs.select(key, "attribute", "value").distinct().join(vocabulary.select("attribute", "value"), ["attribute", "value"], "left_semi").select(key, "attribute", "value")

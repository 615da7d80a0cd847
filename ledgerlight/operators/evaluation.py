"""Session metrics and paired inference as aggregations; every replicate is scored anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.inference import ALPHA, CRITERIA, EXCHANGE, FLOOR, MDD_FACTOR, POINTS, TIE, expected_max_of_k, lattice_points, mcnemar_exact, percentile_indices, reduced
from .order import ranked_rows

MISS_TURN = 11
DEPTHS = (1, 3, 5, 10)


def round6(value: Column) -> Column:
    """Six decimals, half to even on the exact binary value: format_number rounds so, Spark's round goes by the decimal text."""
    return F.regexp_replace(F.format_number(value, 6), ",", "").cast("double")


def summary_columns() -> list[Column]:
    return [
        F.count("*").alias("sample_count"),
        round6(F.avg(F.col("hit").cast("double"))).alias("hit_rate"),
        round6(F.avg("reciprocal_rank")).alias("mrr"),
        round6(F.avg(F.coalesce("first_hit_turn", F.lit(MISS_TURN)).cast("double"))).alias("mttc"),
    ]


def efficiency(mttc: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - mttc) / 10.0))


def technical_score(hit_rate: Column, mrr: Column, mttc: Column) -> Column:
    return round6(0.5 * hit_rate + 0.3 * mrr + 0.2 * efficiency(mttc))


def metric_summary(sessions: DataFrame, *by: str) -> DataFrame:
    out = sessions.groupBy(*by).agg(*summary_columns())
    return out.withColumn("efficiency", efficiency(F.col("mttc"))).withColumn("technical_score", technical_score(F.col("hit_rate"), F.col("mrr"), F.col("mttc")))


def scenario_breakout(sessions: DataFrame, by: str = "scenario") -> DataFrame:
    """Metrics of each scenario with its binomial standard error and whether it holds enough sessions to decide."""
    out = metric_summary(sessions, by)
    se = F.sqrt(F.col("hit_rate") * (1 - F.col("hit_rate")) / F.col("sample_count"))
    return out.withColumn("standard_error", se).withColumn("decision_grade", F.col("sample_count") >= 40)


def hit_rate_curve(sessions: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """depth, hit_rate: all depths in one pass over the sessions."""
    one = sessions.agg(*[F.avg(F.coalesce((F.col("best_rank") <= d).cast("double"), F.lit(0.0))).alias(f"d{d}") for d in depths])
    return one.select(F.inline(F.array(*[F.struct(F.lit(d).alias("depth"), round6(F.col(f"d{d}")).alias("hit_rate")) for d in depths])))


def outcome_violations(sessions: DataFrame) -> DataFrame:
    """Sessions whose fields contradict one another, and how."""
    hit, turn, rank, rr = (F.col(c) for c in ("hit", "first_hit_turn", "best_rank", "reciprocal_rank"))
    checks = {
        "hit_without_turn_or_rank": hit & (turn.isNull() | rank.isNull()),
        "miss_with_turn_or_rank": ~hit & (turn.isNotNull() | rank.isNotNull()),
        "turn_out_of_range": turn.isNotNull() & ~turn.between(1, 10),
        "rank_out_of_range": rank.isNotNull() & ~rank.between(1, 10),
        "reciprocal_rank_differs": F.abs(rr - F.when(rank.isNull(), 0.0).otherwise(1.0 / rank)) > 1e-12,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return sessions.withColumn("violation", F.explode(found))


def first_hits(turns: DataFrame, by: str = "session") -> DataFrame:
    """The first turn that shows the target and its rank there; turns: session, turn, rank (null: not shown)."""
    shown = turns.where("rank is not null")
    return shown.groupBy(by).agg(F.min("turn").alias("first_hit_turn"), F.min_by("rank", "turn").alias("best_rank"))


def portable_draw(key: Column, n: int | Column) -> Column:
    """A number from 0 to n-1 that other engines draw alike: 32 bits of an md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % n


MIX, WORD = 73_244_475, (1 << 32) - 1
SALT = 1_000_003


def mixed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with 32 well mixed bits of a value between 0 and 2^32 - 1, from integer steps that other engines take alike."""
    rows = rows.withColumn(name, value)
    for _ in range(2):
        x = F.col(name)
        rows = rows.withColumn(name, (F.shiftright(x, 16).bitwiseXOR(x) * MIX).bitwiseAND(F.lit(WORD)))
    return rows.withColumn(name, F.shiftright(name, 16).bitwiseXOR(F.col(name)))


def drawn(resamples: int, n: int, spark: SparkSession, salt: int = 0) -> DataFrame:
    """rep, i, draw (32 bits): one row for each of n draws of each replicate."""
    rows = spark.range(resamples * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), F.expr(f"id % {max(n, 1)}").alias("i"))
    rows = mixed(mixed(rows, "_r", F.col("rep") + salt), "_i", (F.col("i") + (1 << 31)).bitwiseAND(F.lit(WORD)))  # apart from the replicates' numbers
    return mixed(rows, "draw", F.col("_r").bitwiseXOR(F.col("_i"))).drop("_r", "_i")


def score_of(prefix: str) -> Column:
    c = {k: round6(F.avg(f"{prefix}_{k}")) for k in ("hit", "rr", "turn")}
    return technical_score(c["hit"], c["rr"], c["turn"])


def paired(baseline: DataFrame, candidate: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of both arms by sample; an orphan is an error, found in the same pass."""
    cols = lambda df, p: df.select(F.col(key).alias(f"_{p}"), F.col("hit").cast("double").alias(f"{p}_hit"), F.col("reciprocal_rank").alias(f"{p}_rr"), F.coalesce("first_hit_turn", F.lit(MISS_TURN)).cast("double").alias(f"{p}_turn"))
    both = cols(baseline, "a").join(cols(candidate, "b"), F.col("_a") == F.col("_b"), "full_outer")
    orphan = F.raise_error(F.concat(F.lit("unpaired sample "), F.coalesce("_a", "_b").cast("string"))).cast("string")
    return both.withColumn(key, F.when(F.col("_a").isNull() | F.col("_b").isNull(), orphan).otherwise(F.col("_a").cast("string"))).drop("_a", "_b")


SESSIONS = 1_000_000  # pairs up to which they, 60 bytes each, go to every task


def _numbered(pairs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """pairs with their place in the order of the key, and their number. Beyond SESSIONS they are not sent to every task."""
    numbered = ranked_rows(pairs, key, name="pos")
    n = pairs.count()
    return (F.broadcast(numbered) if n <= SESSIONS else numbered), n


def bootstrap_replicates(pairs: DataFrame, resamples: int, key: str = "sample_id") -> DataFrame:
    """rep, delta: scores of resampled pairs. Draws join pairs by number; sums are combined before they are shuffled.

    The pairs are an evaluation's sessions, a few hundred to thousands; resamples times as many draws are spread out.
    """
    numbered, n = _numbered(pairs, key)
    draws = drawn(resamples, n, pairs.sparkSession).select("rep", (F.col("draw") % n).alias("pos"))
    # every draw is a pair's number: an inner join would test draws for null first, and take them twice
    return draws.join(numbered, "pos", "left").groupBy("rep").agg((score_of("b") - score_of("a")).alias("delta"))


def permutation_replicates(pairs: DataFrame, resamples: int, key: str = "sample_id") -> DataFrame:
    """rep, delta: the arms of each pair swapped by a coin."""
    numbered, n = _numbered(pairs, key)
    coins = drawn(resamples, n, pairs.sparkSession, SALT).select("rep", F.col("i").alias("pos"), (F.col("draw") % 2 == 1).alias("swap"))
    reps, swap = coins.join(numbered, "pos", "left"), F.col("swap")
    for k in ("hit", "rr", "turn"):
        reps = reps.withColumn(f"x_{k}", F.when(swap, F.col(f"b_{k}")).otherwise(F.col(f"a_{k}"))).withColumn(f"y_{k}", F.when(swap, F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")))
    return reps.groupBy("rep").agg((score_of("y") - score_of("x")).alias("delta"))


def bootstrap_interval(replicates: DataFrame, resamples: int) -> DataFrame:
    """low, high, standard_error, minimum_detectable: order statistics by rank, not interpolated."""
    low, high = percentile_indices(resamples)
    w = Window.orderBy("delta", "rep")
    rows = replicates.withColumn("_at", F.row_number().over(w) - 1)
    return rows.agg(
        F.max(F.when(F.col("_at") == low, F.col("delta"))).alias("low"), F.max(F.when(F.col("_at") == high, F.col("delta"))).alias("high"), F.stddev_pop("delta").alias("standard_error"),
        (F.stddev_pop("delta") * MDD_FACTOR).alias("minimum_detectable"),
    )


def permutation_p(replicates: DataFrame, observed: float) -> DataFrame:
    extreme = F.sum((F.abs("delta") >= abs(observed) - TIE).cast("bigint"))
    return replicates.agg(((extreme + 1) / (F.count("*") + 1)).alias("p_value"))


def sign_flip_p(differences: DataFrame, n: int, key: str = "pos") -> DataFrame:
    """Exact p over all 2^n sign patterns (n at most 20); differences: pos, d."""
    if n > 20:
        raise ValueError("exact enumeration takes at most 20 differences")
    masks = differences.sparkSession.range(1 << n).withColumnRenamed("id", "mask")
    sign = F.when(F.expr(f"shiftright(mask, cast({key} as int)) & 1") == 1, -F.col("d")).otherwise(F.col("d"))
    sums = masks.crossJoin(F.broadcast(differences)).groupBy("mask").agg(F.sum(sign).alias("s"))  # at most 20 differences
    observed = F.max(F.when(F.col("mask") == 0, F.abs("s")))
    total = sums.agg(observed.alias("o"), F.collect_list(F.abs("s")).alias("all")) if n <= 12 else None
    if total is not None:
        return total.select((F.size(F.filter("all", lambda x: x / n >= F.col("o") / n - TIE)) / F.size("all")).alias("p_value"))
    o = sums.where("mask = 0").select(F.abs("s").alias("o"))
    return sums.crossJoin(F.broadcast(o)).agg(F.avg((F.abs("s") / n >= F.col("o") / n - TIE).cast("double")).alias("p_value"))


def sign_flip_p_of_all(differences: DataFrame, steps: int) -> DataFrame:
    """Exact p over the sign patterns of all differences (column d), which are multiples of 1 / steps between -1 and 1.

    However many rows there are, they take 2 steps + 1 values at most, whose counts are one row; the transform's points,
    as many as the differences have steps in all, are dealt to tasks in ranges of POINTS."""
    whole = F.round(F.col("d") * steps).cast("bigint")
    odd = F.raise_error(F.concat(F.lit("not a multiple of the step, or beyond 1: "), F.col("d").cast("string"))).cast("bigint")
    wrong = (F.abs(F.col("d") * steps - whole) > 1e-6) | (F.abs("d") > 1)
    counts = differences.where("d is not null").select(F.when(wrong, odd).otherwise(whole).alias("v")).groupBy("v").agg(F.count("*").alias("m"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("v", "m"))).alias("counts"))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in batch["counts"]:
                sizes, observed = reduced({r["v"]: r["m"] for r in rows})
                total = sum(v * m for v, m in sizes.items())
                yield pd.DataFrame({"sizes": [list(sizes)], "times": [list(sizes.values())], "total": total, "observed": observed, "ranges": -(-total // POINTS) if observed else 0})

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [
                lattice_points(dict(zip(v.tolist(), m.tolist(), strict=True)), o, 1 + k * POINTS, 1 + min(t, (k + 1) * POINTS)) if k >= 0 else 0.0
                for v, m, o, t, k in zip(b["sizes"], b["times"], b["observed"], b["total"], b["k"], strict=True)
            ]
            yield pd.DataFrame({"inside": sums, "total": b["total"], "observed": b["observed"]})

    plan = one.mapInPandas(ranges, "sizes array<long>, times array<long>, total long, observed long, ranges long")
    dealt = plan.withColumn("k", F.explode(F.when(F.col("ranges") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("ranges") - 1)).otherwise(F.array(F.lit(-1).cast("bigint")))))
    n = int(differences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = dealt.repartition(n, "k").mapInPandas(points, "inside double, total long, observed long")
    p = 1 - (2 * F.col("observed") - 1 + F.col("inside")) / (2 * F.col("total") + 1)
    out = summed.groupBy("total", "observed").agg(F.sum("inside").alias("inside"))
    return out.select(F.when(F.col("observed") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).alias("p_value"))


def holm_adjust(tests: DataFrame, p: str = "p_value", key: str = "name") -> DataFrame:
    """Step-down adjusted p values: a running maximum in order of p. One row for each comparison of a family."""
    order = Window.orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_s", step).withColumn("holm_p", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def mcnemar_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """b: only the first arm hits, c: only the second, discordance and the change in hit rate. pairs: a_hit, b_hit."""
    a, b = F.col("a_hit") == 1, F.col("b_hit") == 1
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum((a & ~b).cast("bigint")).alias("b"), F.sum((~a & b).cast("bigint")).alias("c"))
    return out.withColumn("discordance", (F.col("b") + F.col("c")) / F.col("n")).withColumn("delta_hit_rate", (F.col("c") - F.col("b")) / F.col("n"))


def leaderboard(entries: DataFrame) -> DataFrame:
    return entries.withColumn("place", F.row_number().over(Window.orderBy(F.col("technical_score").desc(), "fingerprint")))


def attribute_misses(flags: DataFrame) -> DataFrame:
    """reason of each miss, by priority; flags: rejected, incompatible, in_population, in_slate, route_failed, has_metadata."""
    c = F.col
    reason = (
        F.when(c("rejected") | (~c("in_population") & c("incompatible")), "target_rejected")
        .when(c("in_population") & ~c("in_slate"), "target_ranked_below_ten")
        .when(c("route_failed"), "route_failure")
        .when(~c("has_metadata"), "insufficient_target_metadata")
        .when(~c("in_population") & ~c("incompatible"), "target_not_retrieved")
        .otherwise("unknown")
    )
    return flags.withColumn("reason", reason)


def restrict_to_shared(control: DataFrame, probe: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both arms narrowed to the pairs that both have, and dropped: the keys that one of them lacks, with its side."""
    a, b = control.select(key).distinct(), probe.select(key).distinct()
    dropped = a.join(b, key, "left_anti").withColumn("side", F.lit("control")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("probe")))
    return control.join(b, key, "left_semi"), probe.join(a, key, "left_semi"), dropped


def contrast_scenarios(pairs: DataFrame, by: str = "scenario") -> DataFrame:
    """scenario (the control's), pairs, hit_rate_delta, discordant, standard_error of the control's rate. pairs: a_hit, b_hit."""
    a, b = F.col("a_hit"), F.col("b_hit")
    out = pairs.groupBy(by).agg(F.count("*").alias("pairs"), F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.sum((a != b).cast("bigint")).alias("discordant"))
    rate = F.col("_a") / F.col("pairs")
    return out.select(by, "pairs", ((F.col("_b") - F.col("_a")) / F.col("pairs")).alias("hit_rate_delta"), "discordant", F.sqrt(rate * (1 - rate) / F.col("pairs")).alias("standard_error"))


def paired_contrast(pairs: DataFrame, resamples: int, dropped: int = 0, key: str = "sample_id") -> DataFrame:
    """One row: counts, McNemar's, the score's difference with its bootstrap interval; no adjustment for a family of tests."""
    m = mcnemar_counts(pairs).first()
    interval = bootstrap_interval(bootstrap_replicates(pairs, resamples, key), resamples)
    observed = pairs.agg((score_of("b") - score_of("a")).alias("delta"))
    fixed = {
        "pair_count": F.lit(m["n"]).cast("bigint"), "dropped_pair_count": F.lit(dropped).cast("bigint"), "favouring_control": F.lit(m["b"]).cast("bigint"), "favouring_probe": F.lit(m["c"]).cast("bigint"),
        "discordance_rate": F.lit(m["discordance"]), "hit_rate_delta": F.lit(m["delta_hit_rate"]), "mcnemar_p": F.lit(mcnemar_exact(m["b"], m["c"])),
    }
    return observed.crossJoin(interval).select(*[c.alias(n) for n, c in fixed.items()], "delta", "low", "high", "standard_error", "minimum_detectable")  # a row each


def adjudicate(rows: DataFrame, k: int) -> DataFrame:
    """rows (name, fingerprint, delta, standard_error, p_value, hit_rate_delta, mrr_delta, mttc_delta) with what decides: holm_p,
    the detectable and the corrected difference, the criteria that failed, the verdict, and which is the champion."""
    out = holm_adjust(rows)
    out = out.withColumn("minimum_detectable", F.col("standard_error") * MDD_FACTOR).withColumn("corrected_delta", F.col("delta") - F.col("standard_error") * expected_max_of_k(k))
    met = (
        F.col("holm_p") < ALPHA, F.col("corrected_delta") >= FLOOR,
        (F.col("hit_rate_delta") >= 0) | ((F.col("mrr_delta") > 0) & (F.col("mrr_delta") > EXCHANGE * F.abs("mttc_delta"))),
    )
    out = out.withColumn("failed_criteria", F.filter(F.array(*[F.when(~m, F.lit(n)) for n, m in zip(CRITERIA, met, strict=True)]), lambda x: x.isNotNull()))
    verdict = (
        F.when(F.size("failed_criteria") == 0, "win").when(F.col("holm_p") < ALPHA, "significant, below ship bar")
        .when(F.abs("delta") < F.col("minimum_detectable"), "not detectable").otherwise("no difference")
    )
    best = out.agg(F.min_by("fingerprint", F.struct(-F.col("delta"), F.col("fingerprint"))).alias("_best"))  # one row
    return out.withColumn("verdict", verdict).crossJoin(F.broadcast(best)).withColumn("is_champion", F.col("fingerprint") == F.col("_best")).drop("_best")


def corpus_baselines(sessions: DataFrame, corpus: str = "corpus", scenario: str = "scenario") -> DataFrame:
    """One candidate's metrics on each corpus, with the number of its scenarios; a session twice in a corpus is an error."""
    twice = sessions.groupBy(corpus, "sample_id").count().where("count > 1").limit(1)
    out = metric_summary(sessions, corpus).join(sessions.groupBy(corpus).agg(F.countDistinct(scenario).alias("scenarios")), corpus)
    wrong = twice.agg(F.first("sample_id").cast("string").alias("_twice"))
    fail = F.raise_error(F.concat(F.lit("a corpus has twice "), F.col("_twice"))).cast("bigint")
    return out.crossJoin(F.broadcast(wrong)).withColumn("scenarios", F.when(F.col("_twice").isNull(), F.col("scenarios")).otherwise(fail)).drop("_twice", "efficiency")


def miss_classes(flags: DataFrame, *names: str) -> DataFrame:
    """class, n: how many misses bear each of several labels; labels without any count 0."""
    one = flags.agg(*[F.coalesce(F.sum(F.col(n).cast("bigint")), F.lit(0)).alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("n")) for n in names])))


def with_failures(sessions: DataFrame, failures: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every session with the reason of its miss, null for hits and where none is recorded."""
    return sessions.join(failures.select(key, F.col("reason").alias("miss_reason")), key, "left")

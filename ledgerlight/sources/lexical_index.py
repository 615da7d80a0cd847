"""A stored lexical index: postings in blocks with each block's greatest weight, terms and totals.

    <index>/blocks  term, zone, part, top, n, entries (id, impact, weighted_frequency), sorted by term
           /terms   term, document_frequency (products), weighted_df (the truncated sum of weights)
           /totals  one row: total, mean (tokens in all fields), full_text (whether impacts are there)

A zone holds texts of like length, a part of a zone PART texts or so; blocks of all terms are cut at the same places. An impact
is BM25's share of a posting without its term's rarity, so that the sum of the blocks' tops times rarities bounds every score
in a place. A search scores the places of highest bound, takes the k-th score found as a threshold and reads the entries only of
places that can still reach it. The result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, ordered_tokens
from ..operators.search import B, K1, TOKEN_CAP, WORK_LIMIT

PART = 1 << 14
SEEDS = 4  # places that are scored for the threshold


@dataclass(frozen=True)
class LexicalIndex:
    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame


def term_counts(texts: DataFrame, fields: dict[str, float], key: str = "id", terms: list[str] | None = None) -> DataFrame:
    """id, term, length, tf, weighted_frequency: a text's weighted count of a term, and the sum of the weights of the fields that
    hold it. A task counts its texts' terms before they are shuffled. terms: the only ones counted, if named; lengths are whole."""
    held = [ordered_tokens(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    rows = texts.select(F.col(key).alias("id"), *[t.alias(f"_{i}") for i, t in enumerate(held)])
    length = sum((F.size(f"_{i}") for i in range(1, len(held))), F.size("_0"))
    entry = lambda i: lambda t: F.struct(t.alias("term"), F.lit(i).alias("field"))
    entries = F.concat(*[F.transform(f"_{i}", entry(i)) for i in range(len(held))])
    if terms is not None:
        entries = F.filter(entries, lambda e: e["term"].isin(terms))
    said = rows.select("id", length.alias("length"), F.explode(entries).alias("e")).select("id", "length", "e.term", "e.field")
    counts = [F.count_if(F.col("field") == i).alias(f"c{i}") for i in range(len(held))]
    rows = said.groupBy("id", "length", "term").agg(*counts)
    tf = sum((F.col(f"c{i}") * w for i, w in enumerate(fields.values())), F.lit(0.0))
    weighted = sum((F.when(F.col(f"c{i}") > 0, F.lit(w)).otherwise(0.0) for i, w in enumerate(fields.values())), F.lit(0.0))
    return rows.select("id", "term", "length", tf.alias("tf"), weighted.alias("weighted_frequency"))


def build_index(texts: DataFrame, fields: dict[str, float], path: str, key: str = "id", full_text: bool = True, words: list[str] | None = None) -> LexicalIndex:
    """The index of whole texts; words: the only ones that will be sought, if they are known. Lengths and totals count all words."""
    spark = texts.sparkSession
    tokens = sum((F.regexp_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(TOKEN)) for c in fields), F.lit(0))
    texts.select(tokens.alias("n")).agg(F.count("*").alias("total"), F.avg("n").alias("mean")).withColumn("full_text", F.lit(full_text)).write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals")
    rows = term_counts(texts, fields, key, words).crossJoin(F.broadcast(totals))  # one row of totals
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    place = F.floor(4 * F.log2(F.col("length") + 1)).cast("int").alias("zone"), F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / PART)).cast("int").alias("part")
    rows = rows.select("term", *place, F.struct("id", (impact if full_text else F.lit(None).cast("double")).alias("impact"), "weighted_frequency").alias("e"))
    blocks = rows.groupBy("term", "zone", "part").agg(F.max("e.impact").alias("top"), F.count("*").alias("n"), F.sum("e.weighted_frequency").alias("weight"), F.collect_list("e").alias("entries"))
    blocks.repartitionByRange("term").sortWithinPartitions("term", "zone").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    terms = blocks.groupBy("term").agg(F.sum("n").alias("document_frequency"), F.floor(F.sum("weight")).cast("bigint").alias("weighted_df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "totals")))


def query_terms(words: list[str]) -> list[str]:
    return list(dict.fromkeys(words))[:TOKEN_CAP]


def _rarity(index: LexicalIndex, terms: list[str]) -> DataFrame:
    """term, idf of the query's terms, TOKEN_CAP at most."""
    total = index.totals.select("total").scalar()
    idf = F.log((total - F.col("document_frequency") + 0.5) / (F.col("document_frequency") + 0.5))
    return F.broadcast(index.terms.where(F.col("term").isin(terms)).select("term", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf")))


def _scores(blocks: DataFrame, rarity: DataFrame, value: str, allowed: DataFrame | None) -> DataFrame:
    rows = blocks.join(rarity, "term").select("idf", F.explode("entries").alias("e")).select(F.col("e.id").alias("id"), (F.col("idf") * F.col(f"e.{value}")).alias("s"))
    if allowed is not None:
        rows = rows.join(allowed.select("id"), "id", "left_semi")
    return rows.groupBy("id").agg(F.sum("s").alias("score"))


def bounds(index: LexicalIndex, terms: list[str]) -> DataFrame:
    """zone, part, bound: what no score in a place exceeds, from the blocks' tops alone."""
    tops = index.blocks.where(F.col("term").isin(terms)).select("term", "zone", "part", "top")
    return tops.join(_rarity(index, terms), "term").groupBy("zone", "part").agg(F.sum(F.col("top") * F.col("idf")).alias("bound"))


def bm25_candidates(index: LexicalIndex, terms: list[str], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """id, score of all texts of the places that may hold one of the k best. allowed: the ids that count, if not all."""
    places, rarity = bounds(index, terms), _rarity(index, terms)
    own = index.blocks.where(F.col("term").isin(terms))
    seeds = places.orderBy(F.col("bound").desc(), "zone", "part").limit(SEEDS)
    best = _scores(own.join(F.broadcast(seeds.select("zone", "part")), ["zone", "part"], "left_semi"), rarity, "impact", allowed).orderBy(F.col("score").desc()).limit(k)
    least = best.agg(F.when(F.count("*") == k, F.min("score")).alias("least")).select(F.coalesce("least", F.lit(-1.0))).scalar()
    live = places.where(F.col("bound") >= least - 1e-9).select("zone", "part")
    return _scores(own.join(live, ["zone", "part"], "left_semi"), rarity, "impact", allowed)


def tfidf_scores(index: LexicalIndex, terms: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """id, score: weights times rarity, by truncated sums of weights."""
    total = index.totals.select("total").scalar()
    rarity = index.terms.where(F.col("term").isin(terms)).select("term", (F.log((total + 1) / (F.col("weighted_df") + 1)) + 1).alias("idf"))
    return _scores(index.blocks.where(F.col("term").isin(terms)), F.broadcast(rarity), "weighted_frequency", allowed)


def lexical_search(index: LexicalIndex, words: list[str], k: int, mode: str = "auto", work_limit: int = WORK_LIMIT, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits: id, score, the k best; outcome: one row of reason, total, relation, work).

    auto searches by BM25 where the index has impacts, and else falls back on TF-IDF; full_text has no fallback; fallback is TF-IDF
    always. The fallback gives nothing if its terms have more postings than the work limit."""
    if mode not in ("auto", "full_text", "fallback"):
        raise ValueError(f"no such mode: {mode}")
    terms, total = query_terms(words), lambda n: F.lit(n).cast("bigint")
    none = index.blocks.select(F.col("entries")[0]["id"].alias("id"), F.col("top").alias("score")).limit(0)
    one = index.totals.select("full_text")
    shown = lambda reason, found, relation, work: one.select(reason.alias("reason"), found.alias("total"), relation.alias("relation"), work.alias("work"))
    if not terms:
        return none, shown(F.lit("empty_query"), total(0), F.lit("exact"), total(0))
    there: Column = index.totals.select("full_text").scalar()
    # an index is what it is while a query runs: the branch not taken reads nothing
    best = bm25_candidates(index, terms, k + 1, allowed) if mode != "fallback" else None
    postings = index.terms.where(F.col("term").isin(terms)).agg(F.coalesce(F.sum("document_frequency"), F.lit(0)).alias("n"), F.coalesce(F.max("document_frequency"), F.lit(0)).alias("most"))
    work, most = postings.select("n").scalar(), postings.select("most").scalar()
    fallback = tfidf_scores(index, terms, allowed).where(work <= work_limit) if mode != "full_text" else None
    if mode == "fallback":
        hits = fallback
    elif mode == "full_text":
        hits = best.where(there)
    else:
        hits = best.where(there).unionByName(fallback.where(~there))
    ordered = hits.orderBy(F.col("score").desc(), "id")
    counted = hits.agg(F.count("*")).scalar()
    by_words = F.lit(mode != "fallback") & there
    over = ~by_words & F.lit(mode != "full_text") & (work > work_limit)
    reason = (
        F.when(by_words, "completed").when(F.lit(mode == "full_text"), "full_text_unavailable").when(over, "work_limit_exceeded")
        .when(F.lit(mode == "fallback"), "fallback_completed").otherwise("full_text_unavailable")
    )
    more = by_words & (counted > k)
    found = F.when(by_words, F.least(counted, F.lit(k + 1))).when(over, most).otherwise(counted)
    relation = F.when(more | over | (~by_words & F.lit(mode == "full_text")), "lower_bound").otherwise("exact")
    used = F.when(by_words, F.least(counted, F.lit(k))).when(over, F.lit(work_limit)).when(F.lit(mode == "full_text"), F.lit(0)).otherwise(work)
    return ordered.limit(k), shown(reason, found.cast("bigint"), relation, used.cast("bigint"))


def batch_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query, id, score of every query at once, by TF-IDF. queries: query, term, each pair once. Terms meet their blocks once,
    however many queries ask for them; entries are exploded after that join."""
    total = index.totals.select("total").scalar()
    asked = queries.join(index.terms, "term").select("query", "term", (F.log((total + 1) / (F.col("weighted_df") + 1)) + 1).alias("idf"))
    rows = asked.join(index.blocks.select("term", "entries"), "term").select("query", "idf", F.explode("entries").alias("e"))
    return rows.groupBy("query", F.col("e.id").alias("id")).agg(F.sum(F.col("idf") * F.col("e.weighted_frequency")).alias("score"))

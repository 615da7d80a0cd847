"""Hard-filtered search by several routes, each a DataFrame of ranked hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN

ROUTE_WEIGHTS = {"metadata": 1.40, "exact_fts": 1.20, "expanded_fts": 0.80, "category_fallback": 0.25, "counterfactual": 0.15}
ROUTE_LIMIT = 1000
WORK_LIMIT = 250_000
TOKEN_CAP = 40
K1, B = 1.2, 0.75
FIRM_EVIDENCE = ("explicit_requirement", "category_anchor")

# fixed values: synonyms of query words
EXPANSIONS = {
    "boots": ("boot", "footwear"),
    "boot": ("boots", "footwear"),
    "shoes": ("shoe", "footwear"),
    "shoe": ("shoes", "footwear"),
    "waterproof": ("water resistant", "weather resistant"),
    "warm": ("insulated", "thermal", "lined"),
}


@dataclass(frozen=True)
class Constraint:
    attribute: str
    value: str
    operator: str = "equals"
    excluded: bool = False
    strength: str = "hard"
    confidence: float = 0.98
    evidence: str = "explicit_requirement"
    id: str = ""
    recovered: int = 0

    def __post_init__(self) -> None:
        if self.strength == "hard" and self.confidence < 0.90:
            raise ValueError("a hard constraint needs a confidence of 0.90")
        if self.attribute == "budget":
            float(self.value)


def price_filter(price: Column, c: Constraint) -> Column:
    """An unknown price fails every bound and passes every excluded one."""
    bound = float(c.value)
    test = {"less_than_or_equal": price <= bound, "greater_than_or_equal": price >= bound}.get(c.operator, price == bound)
    return price.isNull() | ~test if c.excluded else price.isNotNull() & test


def hard_filter(products: DataFrame, attribute_rows: DataFrame, constraints: list[Constraint], key: str = "id") -> DataFrame:
    """Products that meet every hard constraint: semi joins for values, anti joins for excluded ones, prices in place."""
    for c in constraints:
        if c.attribute == "budget":
            products = products.where(price_filter(F.col("price"), c))
        else:
            holders = attribute_rows.where((F.col("attribute") == c.attribute) & (F.col("value") == c.value)).select(key)
            products = products.join(holders, key, "left_anti" if c.excluded else "left_semi")
    return products


def soft_target(products: DataFrame, attribute_rows: DataFrame, targets: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """Products with any of the values, as one semi join."""
    wanted = F.lit(False)
    for a, v in targets:
        wanted = wanted | ((F.col("attribute") == a) & (F.col("value") == v))
    return products.join(attribute_rows.where(wanted).select(key), key, "left_semi")


def ranked(hits: DataFrame, k: int, score: str = "score", key: str = "id", route: list[str] | None = None) -> DataFrame:
    """The best k by score, ties by id, numbered from 1; per route if named. Ranks are cut before rows are moved."""
    order = [F.col(score).desc(), F.col(key)]
    if route:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*route).orderBy(*order))).where(F.col("rank") <= k)
    top = hits.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def quality_topk(products: DataFrame, k: int, prior: str = "quality_prior", key: str = "id", work_limit: int = WORK_LIMIT) -> DataFrame:
    """Hits by prior; none if more are asked for than the work limit allows."""
    hits = products.select(key, F.col(prior).alias("score"))
    return ranked(hits.limit(0) if k > work_limit else hits, k, key=key)


def expand_terms(terms: list[str]) -> list[str]:
    return list(dict.fromkeys([*terms, *(w for t in terms for s in EXPANSIONS.get(t, ()) for w in s.split())]))


def query_terms(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))[:TOKEN_CAP]


def tfidf(postings: DataFrame, frequencies: DataFrame, total: int | Column, terms: list[str], key: str = "id") -> DataFrame:
    """id, score: the sum over terms of weight times idf. The query's terms are few, so their frequencies are broadcast."""
    df = F.broadcast(frequencies.where(F.col("term").isin(terms)))
    idf = F.log((F.lit(total) + 1) / (F.col("document_frequency") + 1)) + 1 if isinstance(total, int) else F.log((total + 1) / (F.col("document_frequency") + 1)) + 1
    rows = postings.where(F.col("term").isin(terms)).join(df, "term")
    return rows.groupBy(key).agg(F.sum(F.col("weighted_frequency") * idf).alias("score"))


def field_frequencies(products: DataFrame, fields: dict[str, float], terms: list[str], key: str = "id") -> DataFrame:
    """id, length, tf: a product's tokens in all fields, and its weighted count of each query term, in one pass."""
    text = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields}
    word = "(?<![a-z0-9])(?:" + "|".join(terms) + ")(?![a-z0-9])"
    found = [F.regexp_extract_all(t, F.lit(word), F.lit(0)).alias(f"_{c}") for c, t in text.items()]  # the query's words alone
    length = sum((F.regexp_count(t, F.lit(TOKEN)) for t in text.values()), F.lit(0))
    rows = products.select(key, length.alias("length"), *found)
    count = lambda c, t: F.size(F.filter(f"_{c}", lambda x: x == t))
    tf = [sum((count(c, t) * w for c, w in fields.items()), F.lit(0.0)) for t in terms]
    return rows.select(key, "length", F.array(*tf).alias("tf"))


def bm25(products: DataFrame, fields: dict[str, float], terms: list[str], key: str = "id") -> DataFrame:
    """id, score: BM25 with weighted fields; counts, document frequencies and lengths are those of the whole corpus."""
    rows = field_frequencies(products, fields, terms, key)
    n = [F.sum((F.col("tf")[i] > 0).cast("bigint")).alias(f"n{i}") for i in range(len(terms))]
    corpus = rows.agg(F.count("*").alias("total"), F.avg("length").alias("mean"), *n)
    rows = rows.crossJoin(F.broadcast(corpus))  # a single row of totals
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("total") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col("tf")[i]
        part = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        score = score + F.when(f > 0, part).otherwise(0.0)
    hit = F.exists("tf", lambda x: x > 0)
    return rows.where(hit).select(key, score.alias("score"))


def bounded(hits: DataFrame, k: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The best k, and (total, relation): k + 1 as a lower bound if there are more, else the exact number."""
    probe = hits.orderBy(F.col("score").desc(), key).limit(k + 1)
    n = F.count("*")
    return ranked(probe, k, key=key), probe.agg(n.alias("total"), F.when(n > k, "lower_bound").otherwise("exact").alias("relation"))


def facets(products: DataFrame, attribute_rows: DataFrame, names: list[str], key: str = "id", work_limit: int | None = None) -> DataFrame:
    """attribute, value, n over the given products; nothing if the work would pass the limit."""
    if work_limit is not None and products.count() * (len(names) + 1) > work_limit:
        attribute_rows = attribute_rows.limit(0)
    rows = attribute_rows.where(F.col("attribute").isin(names)).join(products.select(key), key, "left_semi")
    return rows.groupBy("attribute", "value").agg(F.count("*").alias("n"))


def by_ids(products: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Known products in the order asked for; ids: id, pos."""
    return products.join(ids, key).orderBy("pos")


@dataclass(frozen=True)
class Plan:
    route: str
    filters: tuple[Constraint, ...]
    targets: tuple[tuple[str, str], ...] = ()
    terms: tuple[str, ...] = ()
    relaxed: str | None = None


def strict_plans(constraints: list[Constraint], category: str | None = None) -> list[Plan]:
    """A metadata route for each attribute with a wanted value (or one without target), exact and expanded words, fallback."""
    hard = tuple(c for c in constraints if c.strength == "hard")
    wanted = [c for c in constraints if not c.excluded and c.attribute != "budget"]
    by: dict[str, list[tuple[str, str]]] = {}
    for c in wanted:
        if c.attribute not in ("use_case", "other"):
            by.setdefault(c.attribute, []).append((c.attribute, c.value))
    plans = [Plan("metadata", hard, tuple(dict.fromkeys(t))) for t in by.values()] or [Plan("metadata", hard)]
    terms = list(dict.fromkeys(t for c in wanted for t in query_terms(c.value)))[:TOKEN_CAP]
    plans.append(Plan("exact_fts", hard, (), tuple(terms)))
    more = expand_terms(terms)
    if more != terms:
        plans.append(Plan("expanded_fts", hard, (), tuple(more[:TOKEN_CAP])))
    return [*plans, Plan("category_fallback", hard, (), (category,) if category else ())]


def relaxation_order(constraints: list[Constraint], strict_total: int, k: int) -> list[Constraint]:
    """Which hard constraints to leave out, in turn: none while k products fit, firm ones only when nothing does."""
    if strict_total >= k:
        return []
    open_ = [c for c in constraints if c.strength == "hard" and not c.excluded]
    key = lambda c: (c.confidence, c.recovered, c.id)
    firm = [c for c in open_ if c.evidence in FIRM_EVIDENCE]
    loose = sorted((c for c in open_ if c not in firm), key=key)
    return loose + (sorted(firm, key=key) if strict_total == 0 else [])


def counterfactual_plans(constraints: list[Constraint], order: list[Constraint]) -> list[Plan]:
    return [
        Plan("counterfactual", tuple(c for c in constraints if c.strength == "hard" and c is not r), (), tuple(t for c in constraints if c is not r and not c.excluded for t in query_terms(c.value)), r.id)
        for r in order
    ]


def leave_one_out(products: DataFrame, attribute_rows: DataFrame, constraints: list[Constraint], key: str = "id") -> DataFrame:
    """id, relaxed: products that fail exactly the one named constraint, from a single pass over the attributes."""
    values = [c for c in constraints if c.attribute != "budget"]
    held = attribute_rows.groupBy(key).agg(*[F.max((F.col("attribute") == c.attribute) & (F.col("value") == c.value)).alias(f"_h{i}") for i, c in enumerate(values)])
    rows = products.join(held, key, "left")
    tests, at = [], 0
    for c in constraints:
        if c.attribute == "budget":
            tests.append(price_filter(F.col("price"), c))
        else:
            has = F.coalesce(F.col(f"_h{at}"), F.lit(False))
            tests.append(~has if c.excluded else has)
            at += 1
    failed = F.filter(F.array(*[F.when(~t, F.lit(c.id)) for t, c in zip(tests, constraints, strict=True)]), lambda x: x.isNotNull())
    return rows.select(key, failed.alias("_f")).where(F.size("_f") == 1).select(key, F.col("_f")[0].alias("relaxed"))

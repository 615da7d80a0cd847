"""From product rows to the relations that search needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, ordered_tokens, search_terms

FIELD_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}
Z = 1.96
VOCABULARY_FLOOR = 2
DEALS = 32  # over which products that name the same value are dealt
KEYED = ("color", "colour", "size", "style")


def optional_float(value: Column) -> Column:
    """A finite number or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def non_negative_int(value: Column, what: str) -> Column:
    text = value.cast("string")
    x = text.try_cast("bigint")
    blank = text.isNull() | (text == "")
    return F.when(blank, F.lit(0)).when(x >= 0, x).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not a count: "), text)).cast("bigint"))


def wilson_prior(average: Column, count: Column) -> Column:
    """Lower bound of the rate average / 5 over count ratings; 0 without any."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), average / 5))
    n = count.cast("double")
    low = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return F.when(average.isNull() | (count <= 0), F.lit(0.0)).otherwise(low)


def attributes(products: DataFrame, lists: dict[str, str] | None = None, scalars: dict[str, str] | None = None, details: str | None = None, key: str = "id") -> DataFrame:
    """id, attribute, value: one row for each distinct value of an attribute, from list, scalar and key/value columns."""
    pair = lambda a, v: F.struct(F.lit(a).alias("attribute"), v.cast("string").alias("value"))
    listed = lambda a, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: pair(a, v))
    parts = [listed(a, c) for a, c in (lists or {}).items()]
    if scalars:
        parts.append(F.array(*[pair(a, F.col(c)) for a, c in scalars.items()]))
    if details:
        parts.append(F.transform(F.col(details), lambda d: F.struct(d["key"].alias("attribute"), d["value"].alias("value"))))
    rows = products.select(key, F.explode(F.array_distinct(F.concat(*parts))).alias("pair"))
    return rows.select(key, "pair.attribute", "pair.value").where("value is not null and value != ''")


def weighted_postings(products: DataFrame, fields: dict[str, float], key: str = "id", terms: list[str] | None = None) -> DataFrame:
    """id, term, weighted_frequency: the sum of the weights of the fields that hold the term; of some terms only, if named.

    Summed within the row, over its terms in order, so that nothing is shuffled.
    """
    held = lambda c: search_terms(F.coalesce(F.col(c), F.lit("")))
    some = lambda c: held(c) if terms is None else F.array_intersect(held(c), F.array(*[F.lit(t) for t in terms]))
    weighted = lambda c, w: F.transform(some(c), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    entries = F.array_sort(F.concat(*[weighted(c, w) for c, w in fields.items()]))

    def summed(e: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            total = x["w"]
            for k in range(1, len(fields)):  # a term's entries stand side by side, one for each field
                total = total + F.when(F.get(e, i + k)["term"] == x["term"], F.get(e, i + k)["w"]).otherwise(F.lit(0.0))
            return F.when((i > 0) & (F.get(e, i - 1)["term"] == x["term"]), F.lit(None)).otherwise(F.struct(x["term"].alias("term"), total.alias("w")))

        return F.filter(F.transform(e, one), lambda x: x.isNotNull())

    rows = products.select(key, F.explode(let(entries, summed)).alias("p"))
    return rows.select(key, F.col("p.term").alias("term"), F.col("p.w").alias("weighted_frequency"))


def term_frequencies(products: DataFrame, fields: dict[str, float]) -> DataFrame:
    """term, weighted_df (the truncated sum of weights over products and fields), df (products). Sums go by term alone; a task adds
    up its products' terms before they are shuffled."""
    held = [search_terms(F.coalesce(F.col(c), F.lit(""))) for c in fields]
    rows = products.select(*[h.alias(f"_{i}") for i, h in enumerate(held)])
    entry = lambda w, one: lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"), F.lit(one).alias("one"))
    # in a product's first field a term counts for it, in others only where no field before has it
    parts = []
    for i, w in enumerate(fields.values()):
        before = F.array_distinct(F.concat(*[F.col(f"_{j}") for j in range(i)])) if i else None
        new = F.col("_0") if before is None else F.array_except(F.col(f"_{i}"), before)
        parts.append(F.transform(new, entry(w, 1)))
        if i:
            parts.append(F.transform(F.array_intersect(F.col(f"_{i}"), before), entry(w, 0)))
    said = rows.select(F.explode(F.concat(*parts)).alias("e")).select("e.term", "e.w", "e.one")
    return said.groupBy("term").agg(F.floor(F.sum("w")).cast("bigint").alias("weighted_df"), F.sum("one").cast("bigint").alias("df"))


def document_frequency(postings: DataFrame, mode: str = "weighted") -> DataFrame:
    """term, document_frequency: the truncated sum of weights, or with mode "count" the number of products."""
    value = F.count("*") if mode == "count" else F.floor(F.sum("weighted_frequency"))
    return postings.groupBy("term").agg(value.cast("bigint").alias("document_frequency"))


def material_vocabulary(details: DataFrame, floor: int = VOCABULARY_FLOOR) -> DataFrame:
    """token: single-token structured materials that at least floor detail pairs have."""
    tokens = details.where("attribute = 'material'").select(ordered_tokens(F.col("value")).alias("t")).where(F.size("t") == 1)
    return tokens.groupBy(F.col("t")[0].alias("token")).count().where(F.col("count") >= floor).select("token")


def feature_material_tokens(feature: Column) -> Column:
    """The head words of a feature's parts, shares of per cent removed: what may name a material."""
    parts = F.split(F.regexp_replace(F.lower(feature), r"\d+\s*(%|percent)", " "), r"\band\b|[/,&+]")
    heads = F.transform(parts, lambda p: F.try_element_at(ordered_tokens(p), F.lit(-1)))
    return F.array_distinct(F.filter(heads, lambda h: h.isNotNull()))


def recovered_materials(products: DataFrame, vocabulary: DataFrame, key: str = "id", features: str = "features") -> DataFrame:
    """id, attribute, value: materials named in features and known as such."""
    heads = products.select(key, F.explode(features).alias("f")).select(key, F.explode(feature_material_tokens(F.col("f"))).alias("token"))
    return heads.distinct().join(vocabulary, "token", "left_semi").select(key, F.lit("material").alias("attribute"), F.col("token").alias("value"))


def keyed_value(feature: Column) -> Column:
    """struct<attribute,value> of a feature like "color: black; ...", else null."""
    name = F.lower(F.trim(F.regexp_extract(feature, r"^\s*([A-Za-z]+)\s*:", 1)))
    clause = F.btrim(F.lower(F.split(F.regexp_extract(feature, r"^\s*[A-Za-z]+\s*:(.*)$", 1), "[;,]")[0]), F.lit(".-\"' "))
    words = F.size(F.split(clause, r"\s+"))
    good = name.isin(*KEYED) & clause.rlike("[a-z]") & (words <= 4) & F.length(clause).between(2, 25)
    return F.when(good, F.struct(F.when(name == "colour", "color").otherwise(name).alias("attribute"), clause.alias("value")))


def keyed_pairs(products: DataFrame, key: str = "id", features: str = "features") -> DataFrame:
    """id, attribute, value: the different keyed features of each product."""
    pairs = products.select(key, F.explode(features).alias("f")).select(key, keyed_value(F.col("f")).alias("p")).where("p is not null")
    return pairs.select(key, "p.attribute", "p.value").distinct()


def known_keyed_values(pairs: DataFrame, floor: int = VOCABULARY_FLOOR) -> DataFrame:
    """attribute, value of the pairs that at least floor products have."""
    return pairs.groupBy("attribute", "value").count().where(F.col("count") >= floor).select("attribute", "value")


def recovered_keyed_values(products: DataFrame, key: str = "id", features: str = "features", floor: int = VOCABULARY_FLOOR) -> DataFrame:
    """id, attribute, value of keyed features whose pair at least floor products have."""
    pairs = keyed_pairs(products, key, features)
    return pairs.join(known_keyed_values(pairs, floor), ["attribute", "value"], "left_semi").select(key, "attribute", "value")


def folded_details(products: DataFrame, materials: DataFrame, keyed: DataFrame, key: str = "id", details: str = "details", features: str = "features") -> DataFrame:
    """products with what their features reveal added to their details: known materials, then known keyed values, in the
    order of the features, none that is there already. materials: token; keyed: attribute, value."""
    pair = "array<struct<key:string,value:string>>"
    own = F.coalesce(F.col(details), F.array().cast(pair))
    heads = F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(features), F.array().cast("array<string>")), feature_material_tokens)))
    named = F.transform(heads, lambda t: F.struct(F.lit("material").alias("key"), t.alias("value")))
    told = F.filter(F.transform(F.coalesce(F.col(features), F.array().cast("array<string>")), keyed_value), lambda p: p.isNotNull())
    told = F.transform(told, lambda p: F.struct(p["attribute"].alias("key"), p["value"].alias("value")))
    rows = products.select(key, F.posexplode(F.array_except(F.array_distinct(F.concat(named, told)), own)).alias("at", "d"))
    known = materials.select(F.lit("material").alias("key"), F.col("token").alias("value")).union(keyed.select("attribute", "value")).distinct()
    rows = rows.select(key, "at", F.col("d.key").alias("key"), F.col("d.value").alias("value"), F.pmod(F.xxhash64(key), F.lit(DEALS)).cast("int").alias("deal"))
    known = known.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    # merged and dealt by number: rows of products compress so well that Spark would broadcast them or merge their partitions
    # into one task, which then holds all products
    n = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["key", "value", "deal"]
    rows = rows.repartition(n, *at).hint("merge").join(known.repartition(n, *at), at).repartition(n, key)
    added = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "key", "value"))).alias("_added"))
    added = added.select(F.col(key).alias("_key"), F.transform("_added", lambda d: F.struct(d["key"].alias("key"), d["value"].alias("value"))).alias("_added"))
    out = products.repartition(n, key).hint("merge").join(added, F.col(key) == F.col("_key"), "left")
    full = F.concat(own, F.coalesce("_added", F.array().cast(pair)))
    return out.withColumn(details, full).drop("_key", "_added")


def value_counts(attribute_rows: DataFrame) -> DataFrame:
    return attribute_rows.groupBy("attribute", "value").agg(F.count("*").alias("n"))


def gist_vocabulary(attribute_rows: DataFrame, floor: int = 10) -> DataFrame:
    return value_counts(attribute_rows).where(F.col("n") >= floor)


def resolve_phrases(attribute_rows: DataFrame, priority: list[str], floor: int = 2, exempt: str = "size", residual: str = "feature") -> DataFrame:
    """phrase, value, attribute: the one reading of a phrase, by frequency, then priority.

    Structured readings need floor products (exempt needs none); the residual attribute is read when no other is left.
    """
    from ..functions.text import STOPWORDS

    counts = value_counts(attribute_rows).withColumn("phrase", F.concat_ws(" ", ordered_tokens(F.col("value"))))
    rank = F.array_position(F.array(*[F.lit(a) for a in priority]), F.col("attribute"))
    many = F.size(F.split("phrase", " ")) > 1
    fits = (F.col("attribute") == exempt) | (F.col("n") >= floor) | many
    counts = counts.where((F.length("phrase") > 1) & ~F.col("phrase").isin(STOPWORDS) & (rank > 0) & fits)
    order = F.struct((F.col("attribute") != residual).cast("int").alias("s"), F.col("n"), (-rank).alias("r"), F.col("value").alias("v"))
    return counts.groupBy("phrase").agg(F.max_by("value", order).alias("value"), F.max_by("attribute", order).alias("attribute"))

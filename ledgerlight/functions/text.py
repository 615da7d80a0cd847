"""Text columns: normalization, tokens, keys, and the keyword rules on them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = "[a-z0-9]+"

# fixed values: English stop words
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()

# fixed values: the keyword cascade of constraint classes, first match wins
MATERIAL_WORDS = "cotton polyester nylon leather wool spandex silk rayon fabric".split()
CLASS_WORDS = (
    ("color", "color black white blue red pink green".split()),
    ("size", "size sizing width wide narrow".split()),
    ("style", "department style fit sleeve neck".split()),
    ("use_case", "hiking running gym winter outdoor work".split()),
)


def _normalized(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


def normalize_text(value: Column) -> Column:
    """NFKC, case folded, white space collapsed and trimmed. Spark has neither NFKC nor case folding."""
    return F.pandas_udf(_normalized, StringType())(value)


def normalize_ascii(value: Column) -> Column:
    """The same for ASCII text, inside generated code."""
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " "))


def flatten_json(text: Column) -> Column:
    """The keys and scalar values of a JSON text of any depth, in their order, joined by spaces; nulls are left out."""
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+'), F.lit(0))
    plain = F.transform(F.filter(tokens, lambda t: t != "null"), lambda t: F.when(F.startswith(t, F.lit('"')), F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]).otherwise(t))
    return F.array_join(plain, " ")


def match_key(value: Column) -> Column:
    """Spaces around colon, comma and slash do not tell values apart."""
    return F.regexp_replace(value, r"(?U)\s*([:,/])\s*", "$1")


def ordered_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0))


def search_terms(value: Column) -> Column:
    return F.array_distinct(ordered_tokens(value))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: inside a lambda, Spark would compute it for each element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """n-word phrases of a token array, in order, repeats kept."""

    def grams(t: Column) -> Column:
        last = F.size(t) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(t, i, n)))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def bigrams(tokens: Column) -> Column:
    return F.array_distinct(ngrams(tokens, 2))


def content_tokens(tokens: Column, pinned: Column | None = None) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(STOPWORDS))
    return kept if pinned is None else F.filter(kept, lambda t: ~F.array_contains(pinned, t))


def carries_content(phrase: Column) -> Column:
    return F.exists(F.split(phrase, " "), lambda t: ~t.isin(STOPWORDS))


def _any(value: Column, words: list[str]) -> Column:
    return value.rlike("|".join(words))


def classify_constraint(value: Column) -> Column:
    """Which of seven classes a constraint's text falls in."""
    low = F.lower(value)
    out = F.when(low.contains("budget") | low.rlike(r"(\$|<=|under)\s*\d"), "budget").when(_any(low, MATERIAL_WORDS), "material")
    for name, words in CLASS_WORDS:
        out = out.when(_any(low, words), name)
    return out.otherwise("feature")


def pinned_tokens(phrase: Column) -> Column:
    """Tokens that a rewording must keep: those that hold the class's first keyword found in the phrase; a budget's numbers."""
    low = F.lower(phrase)
    tokens = F.array_distinct(ordered_tokens(phrase))

    def holding(words: list[str]) -> Column:
        first = F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(0))
        return F.array_distinct(F.concat(F.filter(tokens, lambda t: F.contains(t, first)), F.array(first)))

    kind = classify_constraint(phrase)
    out = F.when(kind == "budget", F.filter(tokens, lambda t: t.rlike("[0-9]") | (t == "budget")))
    for name, words in (("material", MATERIAL_WORDS), *CLASS_WORDS):
        out = out.when(kind == name, holding(words))
    return out.otherwise(F.array().cast("array<string>"))


def price_bounds(message: Column) -> Column:
    """array<struct<operator,value>> of the upper, then the lower bounds that a message names."""
    upper = r"(?:under|below|at most|up to|max(?:imum)?(?: of)?)\s*\$?\s*(\d+(?:\.\d+)?)"
    lower = r"(?:over|above|at least|min(?:imum)?(?: of)?)\s*\$?\s*(\d+(?:\.\d+)?)"
    each = lambda pattern, op: F.transform(
        F.regexp_extract_all(message, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(op).alias("operator"), canonical_number(v.cast("double")).alias("value"))
    )
    return F.concat(each(upper, "less_than_or_equal"), each(lower, "greater_than_or_equal"))


def canonical_number(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def coarse_category(categories: Column) -> Column:
    """The last two parts, between commas, of a category list."""
    parts = F.transform(F.flatten(F.transform(categories, lambda c: F.split(c, ","))), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry"))
    last = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(kept) == 0, "clothing item").otherwise(F.concat_ws(" ", last))


def constraint_id(turn: Column, attribute: Column, operator: Column, value: Column, excluded: Column, ordinal: Column) -> Column:
    polarity = F.when(excluded, "exclude").otherwise("include")
    return F.concat_ws(":", F.concat(F.lit("t"), turn), attribute, operator, F.regexp_replace(F.coalesce(value, F.lit("none")), " ", "-"), polarity, ordinal)


def parse_constraint_id(text: Column, legacy: bool = False) -> Column:
    """struct<turn,attribute,operator,value,polarity,ordinal>; legacy cuts values at their first colon."""
    p = F.split(text, ":")
    value = F.get(p, F.lit(3)) if legacy else F.array_join(F.slice(p, 4, F.greatest(F.size(p) - 5, F.lit(0))), ":")
    return F.when(
        F.size(p) >= 6,
        F.struct(
            F.substring(p[0], 2, 9).cast("int").alias("turn"), p[1].alias("attribute"), p[2].alias("operator"), F.regexp_replace(value, "-", " ").alias("value"),
            F.element_at(p, -2).alias("polarity"), F.element_at(p, -1).cast("int").alias("ordinal"),
        ),
    )

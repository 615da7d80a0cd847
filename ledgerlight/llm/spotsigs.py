"""SpotSigs document fingerprints, in DataFrame functions only.

A spot signature begins at a common word (an anchor) and chains the CHAIN content words that follow it, SPREAD apart;
content words are those that are no anchors. A document is the set of its signatures; texts without any are the set
of one signature of their words. Two documents are as alike as the Jaccard coefficient of their sets.

Sets of sizes a <= b are at most a / b alike: pairs below the threshold by sizes alone are never compared, and for the
join sets are dealt to partitions by size so that a set meets only its own and the next partition. Within those, pairs
must share one of the rarest signatures of each set (prefix filter), and the exact coefficient is taken last.

Null text: empty. All texts without words have one same fingerprint. Rows without a doc_id come first; rows that repeat a
doc_id follow one another, by a hash of their texts. An empty table gives an empty result; with one document the next
document is itself. In pairs, rows without a doc_id take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, number_rows

CHAIN = 2
SPREAD = 1
THRESHOLD = 0.8

# fixed values: frequent words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or our she so that "
    "the their there they this to was we were what when which who will with you your "
    "aber als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist "
    "mit nach nicht noch nur oder sich sie sind über um und uns von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui que "
    "sa se ses son sur un une vous "
    "al como con del el ella ellos era esta este fue ha hay las lo los más muy no nos para pero por se si sin su sus también te "
    "tiene una uno y ya"
).split()
WORDS = r"[\p{L}\p{N}]+"


def signatures(text: Column, chain: int = CHAIN, spread: int = SPREAD) -> Column:
    """The sorted distinct 32-bit hashes of a text's spot signatures (array of long)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))
    anchors = list(dict.fromkeys(ANCHORS))

    def chains(w: Column) -> Column:
        content = F.filter(w, lambda x: ~x.isin(anchors))
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())

        def spots(c: Column) -> Column:
            # the anchor that is the k-th has k anchors, so i - k content words, before it
            span = spread * (chain - 1) + 1
            begin = F.transform(places, lambda i, k: i - k)
            begin = F.filter(begin, lambda b: b + span <= F.size(c))
            link = lambda b: F.concat_ws(" ", *[F.get(c, b + j * spread) for j in range(chain)])
            return F.transform(begin, lambda b: F.xxhash64(link(b)).bitwiseAND(F.lit(0xFFFFFFFF)))

        found = F.get(F.transform(F.array(content), spots), F.lit(0))
        whole = F.array(F.xxhash64(F.concat_ws(" ", w)).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.get(F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(whole)), F.lit(0))

    # a lambda over an array of one names a value that is used several times
    return F.get(F.transform(F.array(words), chains), F.lit(0))


def as_string(hashes: Column) -> Column:
    """The fingerprint as text: eight hex digits a signature, in ascending order."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of hashes; equal sets and sets without overlap by size are not intersected."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, signatures of each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("signatures"))
    return docs.select("doc_id", as_string(F.col("signatures")).alias("fingerprint"), "signatures")


def _named(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the columns that tell its rows apart: doc_id if it does, else with a text's hash and the number of its copy."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs, ["doc_id"]
    docs = docs.withColumn("_h", F.xxhash64("text"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("text"))
    return docs.withColumn("_copy", copy), ["doc_id", "_h", "_copy"]


def compared(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the beginning of the next document in ascending doc_id. Only the beginning that is
    needed and the next set of signatures travel to a document, and its own text once.
    """
    docs, names = _named(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    ids = number_rows(docs.select(*names, F.length("text").cast("long").alias("n")), *names, name="row")
    total = ids.agg(F.count("*")).first()[0]
    before = [f"_before{i}" for i in range(len(names))]

    def alike(a: list[str], b: list[str]) -> Column:
        same = [F.col(x) == F.col(y) if len(names) == 1 else F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)]
        return reduce(Column.__and__, same)

    # each document's predecessor and how much of this document it wants: by row number, the first follows the last
    wants = ids.select(((F.col("row") + 1) % F.lit(max(1, total))).alias("row"), *[F.col(c).alias(x) for c, x in zip(names, before, strict=True)], F.floor(F.col("n") / 2).cast("int").alias("_wants"))
    own_names = [f"_own{i}" for i in range(len(names))]
    plan = cut(ids.select("row", *[F.col(c).alias(x) for c, x in zip(names, own_names, strict=True)]).join(wants, "row").drop("row"))
    own = docs.join(plan, alike(names, own_names)).drop(*own_names)
    own = own.withColumn("signatures", signatures(F.col("text")))
    after = own.select(*before, F.substring(F.col("text"), F.lit(1), F.col("_wants")).alias("_begin"), F.col("signatures").alias("_next"))
    rows = own.select(*names, "text", "signatures").join(after, alike(names, before))
    n = F.length("text")
    kept = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, "_begin")).withColumn("edited_signatures", signatures(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("signatures")).alias("fingerprint"), as_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("_next")).alias("near_next"),
    )


def near_pairs(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, likeness: pairs of fingerprints at least that alike, named by the smallest doc_id that has each.

    Documents of equal fingerprints are one class; fingerprints() has the membership.
    """
    classes = fingerprints(documents.where("doc_id is not null")).groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("signatures").alias("s"))
    classes = cut(classes.select("id", "s", F.size("s").alias("n")))
    seen = classes.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    ranked = classes.select("id", "n", F.explode("s").alias("h")).join(seen, "h")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    # sets that share too few of their rarest signatures cannot reach the threshold
    prefix = ranked.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9)
    prefix = prefix.select("id", "n", "h", level.alias("level"))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "h", F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h", "level")
    fits = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["h", "level"]).where(fits & (F.col("na") >= F.col("nb") * threshold)).select("a", "b").distinct()
    sets = classes.select("id", "s")
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    pairs = pairs.withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")

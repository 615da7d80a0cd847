"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source whose target is r times its size expects r copies of a document on average, a little more of longer ones: the
expected copies are r (1 + tilt (x - mean)), where x rises with the document's size towards 999 and mean is its mean over the
source's words, so that the expected words are the target. Whole copies are certain. What is left of a document's
expectation is its inclusion probability p, and documents rank by Q = (u / (1 - u)) / (p / (1 - p)), with u a uniform number
from the document's id. The sample is of fixed size, counted in words as all sizes here: the first documents in that order,
as many as bring the source's words nearest its target. Probabilities are whole millionths and sums of sizes whole numbers,
alike in every run.

Null text: size 0. Null source: a source of its own, last. Rows that repeat are documents of their own that get the
same u; ties rank by id and size, and rows equal in all three stand or fall together. An empty table gives
an empty result. Columns beyond those named are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, number_rows, running_total

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3.0
TILT = 0.25  # the longest document's expectation is at most so much above its source's rate, the shortest's below
HALF = 256  # words at which x is half of 1000
MICRO = 1_000_000
BUCKETS = 4096
FEW = 100_000  # sources up to which their table, under 200 bytes for each beside the name, goes to every task


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1, neither of them, from 48 bits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def lengthiness(size: Column) -> Column:
    """0 to 999, rising with size: whole numbers, so that sums are exact."""
    return F.floor(F.lit(1000) * size / (size + HALF)).cast("long")


def source_targets(per: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """per (source, source_size, and more) with weight and target: shares of the total by weight, at most cap times a source's size.

    The level L at which sum(min(cap * size, weight * L)) is the total follows from the sources in order of cap * size
    / weight: those up to some place are full, the others share the rest by weight. Sources are ranked by ranges, so that
    no task gets them all.
    """
    per = number_rows(per.withColumn("_none", F.col("source").isNull()), "_none", "source", name="_nth")
    ratio = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(ratio, (F.pmod(F.col("_nth"), F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("_full", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_full") / F.col("weight"))
    ranked = running_total(per, "_full", "_ratio", "_nth", name="_before")
    ranked = cut(running_total(ranked, "weight", "_ratio", "_nth", name="_before_w"))
    sums = ranked.agg(F.sum("source_size").alias("_total"), F.sum("weight").alias("_weights"))
    level = (F.col("_total") - F.col("_before")) / (F.col("_weights") - F.col("_before_w"))
    free = ranked.crossJoin(F.broadcast(sums)).withColumn("_level", level).where(F.col("_ratio") > F.col("_level"))
    # the first source that is not full fixes the level; with none, every source is full
    first = free.agg(F.min_by("_level", F.struct("_ratio", "_nth")).alias("_level"))
    target = F.when(F.col("_level").isNull(), F.col("_full")).otherwise(F.least("_full", F.col("weight") * F.col("_level")))
    out = ranked.crossJoin(F.broadcast(first)).withColumn("target", F.round(target, 6))
    return out.drop("_none", "_nth", "_full", "_ratio", "_before", "_before_w", "_level")


def expected_micro(size: Column) -> Column:
    """Millionths of the copies that a document's mixture expects; beside it lie its source's columns."""
    e = F.col("_rate") * (1 + F.col("_tilt") * (lengthiness(size) - F.col("_mean")))
    return F.when(F.col("source_size") > 0, F.floor(e * MICRO + 0.5)).otherwise(F.lit(0)).cast("long")


def rank_value(u: Column, micro: Column) -> Column:
    """Q / (1 + Q), which orders like Q and lies between 0 and 1."""
    p = F.pmod(micro, F.lit(MICRO)) / float(MICRO)
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def _beside(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (struct row, source) with the columns of their source's line; a bounded table is sent to every task."""
    line = table.withColumnRenamed("source", "_source")
    line = F.broadcast(line) if table.count() <= FEW else line
    return rows.join(line, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _place() -> Column:
    return F.struct(F.col("_v").alias("v"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.col("size").alias("s"))


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    rows = rows.withColumn("_micro", expected_micro(F.col("size")))
    return rows.withColumn("_v", rank_value(uniform(F.col("doc_id"), seed), F.col("_micro")))


def mix_table(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = CAP, seed: int = 17) -> DataFrame:
    """A line for each source: source_size, target, what makes expectations, and where its sample ends.

    docs: doc_id, source, size. Words by bucket of the order name the bucket in which the sample ends; only that one is
    ranked, a BUCKETS-th part of the source.
    """
    x = lengthiness(F.col("size"))
    per = docs.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * x).alias("_sx"), F.min(x).cast("double").alias("_low"), F.max(x).cast("double").alias("_high")
    )
    per = source_targets(cut(per), weights, cap)
    words = F.nullif("source_size", F.lit(0))
    per = per.withColumn("_rate", F.coalesce(F.col("target") / words, F.lit(0.0))).withColumn("_mean", F.coalesce(F.col("_sx") / words, F.lit(0.0)))
    span = F.greatest(F.col("_high") - F.col("_mean"), F.col("_mean") - F.col("_low"))
    tilt = F.greatest(F.lit(0.0), F.least(F.lit(TILT), F.lit(float(cap)) / F.nullif("_rate", F.lit(0.0)) - 1)) / F.nullif(span, F.lit(0.0))
    per = cut(per.select("source", "weight", "source_size", "target", "_rate", "_mean", F.coalesce(tilt, F.lit(0.0)).alias("_tilt")))

    rows = _ranked(_beside(docs, per), seed).withColumn("_bucket", F.floor(F.col("_v") * BUCKETS))
    drawn = F.col("_micro") % MICRO > 0
    certain = F.sum(F.floor(F.col("_micro") / MICRO) * F.col("size"))
    counted = cut(rows.groupBy("source", F.when(drawn, F.col("_bucket")).alias("_bucket")).agg(F.sum("size").alias("_words"), certain.alias("_certain"), F.first("target").alias("target")))
    left = F.col("target") - F.sum("_certain").over(Window.partitionBy("source"))
    counted = counted.withColumn("_left", left).where("_bucket is not null")
    before = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_words")
    edges = counted.withColumn("_before", before).where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_words") >= F.col("_left")))
    # the last bucket ends it where rounding asks for more words than there are
    most = counted.groupBy("source").agg(F.max("_bucket").alias("_edge"), F.sum("_words").alias("_words"), F.first("_left").alias("_left")).where("_words < _left")
    edges = edges.select("source", F.col("_bucket").alias("_edge"), "_before", "_left").union(most.select("source", F.col("_edge") + 1, F.col("_words"), "_left"))
    edges = cut(edges.withColumnRenamed("source", "_s"))

    here = rows.where(drawn).join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_edge")))
    peers = here.groupBy("source", "_left", "_before", "_v", "doc_id", "size").agg(F.count("*").alias("_n"))
    upto = F.sum(F.col("size") * F.col("_n")).over(Window.partitionBy("source").orderBy("_v", F.col("doc_id").asc_nulls_first(), "size"))
    half = F.col("_before") + F.col("_upto") - F.col("size") * F.col("_n") / 2  # the place nearest the target
    last = peers.withColumn("_upto", upto).where(half <= F.col("_left")).groupBy("source").agg(F.max(_place()).alias("_last"))
    ends = edges.join(last, F.col("_s").eqNullSafe(F.col("source")), "left")
    start = F.struct((F.col("_edge") / float(BUCKETS)).alias("v"), F.lit(-(1 << 63)).alias("i"), F.lit(-1).cast("long").alias("s"))
    ends = ends.select("_s", F.coalesce("_last", start).alias("_end"))
    return cut(per.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def _copies() -> Column:
    drawn = (F.col("_micro") % MICRO > 0) & F.coalesce(_place() <= F.col("_end"), F.lit(False))
    return (F.floor(F.col("_micro") / MICRO) + drawn.cast("int")).cast("int")


def mix(
    documents: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = CAP, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each document. Texts are counted and never moved."""
    docs = cut(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    rows = _ranked(_beside(docs, mix_table(docs, weights, cap, seed)), seed).withColumn("copies", _copies())
    return rows.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(documents: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = CAP, seed: int = 17) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy. Texts stay where they are read."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size")]
    table = mix_table(cut(documents.select(*own)), weights, cap, seed)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *own)
    rows = _ranked(_beside(rows, table), seed).withColumn("copies", _copies()).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")

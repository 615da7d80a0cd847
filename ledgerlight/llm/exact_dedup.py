"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

The first pass reads each text's length and the hash of its first PREFIX bytes and counts the pairs. A pair that occurs
once, as every length that occurs once does, is settled: its text has no equal. The second pass hashes whole texts, but
only those of pairs that are left; a table of WORDS 64-bit words at most says in place which they are, so no text is
moved. A settled text that the table lets through by chance costs its hash only: groups are equal lengths, beginnings and
SHA-256 of the whole. Beyond some WORDS * 64 repeated pairs the table lets most texts through; results stay the same.

Null text: empty. Rows without a doc_id count in their group; one of them stays only where no row of the group has an
id, and keep_id is null then. Of rows that repeat both id and text one is kept. Very long texts are hashed where they
lie. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import attach, cut

PREFIX = 256
WORDS = 1 << 18


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(WORDS - 1))


def repeated(pairs: DataFrame) -> DataFrame:
    """word, mask: a bit for the hash of each (n, start) that occurs more than once. WORDS rows at most."""
    key = F.xxhash64("n", "start")
    bits = pairs.where("held > 1").select(_word(key).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(n, start) & 63 as int))").alias("bit"))
    return bits.groupBy("word").agg(F.bit_or("bit").alias("mask"))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the named columns of each row of documents."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n, start = F.octet_length(text).cast("long").alias("n"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("start")
    pairs = documents.select(n, start).groupBy("n", "start").agg(F.count("*").alias("held"))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), n, start, text.alias("text"), *[c.alias(k) for k, c in more.items()])
    rows = rows.withColumn("word", _word(F.xxhash64("n", "start"))).join(F.broadcast(repeated(pairs)), "word", "left")
    open_ = F.coalesce(F.expr("getbit(mask, cast(xxhash64(n, start) & 63 as int))") == 1, F.lit(False))
    rows = rows.withColumn("whole", F.when(open_, F.unhex(F.sha2("text", 256)))).withColumn("at", F.monotonically_increasing_id())
    rows = cut(rows.select("doc_id", "n", "start", "whole", "at", *more))  # narrow; at stays what it is if an executor is lost

    alone = rows.where("whole is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    left = rows.where("whole is not null")
    groups = left.groupBy("n", "start", "whole").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("held"))
    groups = groups.withColumn("group_size", F.col("held"))
    met = attach(left, groups, "n", "start", "whole")
    met = met.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), *more)
    return met.unionByName(alone)


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents kept, with all their columns. Rows that repeat both id and text stay together; so do those without id."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    gone = classes(documents, gone_digest=digest).where("doc_id != keep_id").select(F.col("doc_id").alias("gone_id"), "gone_digest").distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("row_id"), digest.alias("row_digest"))
    on = (F.col("row_id") == F.col("gone_id")) & (F.col("row_digest") == F.col("gone_digest"))
    return rows.join(gone, on, "left_anti").select("row.*")

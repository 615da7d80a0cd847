"""What the operators share: the cluster's shared folder, cut lineage and row numbers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # Spark keeps a row's place within its partition in this many low bits


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in tests: where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Empties what operators keep in a Python worker from task to task.
forget: list[Callable[[], None]] = []


def release() -> None:
    """Gives up what other operators keep in this Python worker, which lives on from stage to stage, and hands the system
    back what is free."""
    for empty in forget:
        empty()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT = 1000  # a key with more than one in so many rows is hot: fewer than so many are


def attach(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of facts (one row a key, nulls where there is none). facts.held: how many of rows have the key.

    Facts of hot keys, fewer than HOT of them, are broadcast; their rows then go where a salt of their own sends them, so no
    task gets a key's rows. Keys are not null."""
    values = [c for c in facts.columns if c not in keys and c != "held"]
    least = facts.agg(F.sum("held") / HOT).scalar()
    hot = facts.where(F.col("held") > least).select(*keys, F.struct(*values).alias("_hot"))
    rest = facts.select(*keys, F.struct(*values).alias("_rest"), F.least("held", F.lit(0)).alias("_salt"))  # not a literal, by which Spark would not deal rows
    met = rows.join(F.broadcast(hot), list(keys), "left")
    met = met.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    found = met.join(rest, [*keys, "_salt"], "left").select(*rows.columns, F.coalesce("_hot", "_rest").alias("_facts"))
    return found.select(*rows.columns, *[F.col(f"_facts.{c}").alias(c) for c in values])


def number_rows(df: DataFrame, *keys: str, name: str = "row_number") -> DataFrame:
    """df with its place (long, from 0) in ascending order of keys, nulls first.

    The rows are dealt by range, so no task gets them all; only one count a partition is gathered. df should be
    narrow: it is shuffled once and checkpointed, so that a lost executor cannot change the order of ties.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = cut(
        dealt.withColumn("_part", F.shiftright(at, _ROW_BITS)).withColumn("_at", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each partition
    starts = counts.select("_part", before.alias("_start"))
    numbered = dealt.join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def running_total(df: DataFrame, value: str, *keys: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before it (long) in ascending order of keys."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = cut(dealt.withColumn("_part", F.shiftright(at, _ROW_BITS)).withColumn("_at", at))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_n"))
    starts = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("_sum", F.sum(value).over(inside))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_sum") - F.col(value))
        .drop("_part", "_at", "_sum", "_start")
    )


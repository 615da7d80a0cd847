"""JSON lines with the place of each: file and line number, counted without moving or gathering a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CORRUPT = "_corrupt"


def located(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of each line, blank ones too.

    Lines are numbered within the part of a file that a task reads; the counts of parts, a row each, say where each begins."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    parts = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = parts.select("file", "block", "first", before.alias("before"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def judged(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """file, line, row (by the schema), wrong: why a line is not a row, null if it is one. Blank lines are passed over.

    Not an object; malformed or of other types; without a key; with the key of an earlier line of that file or another."""
    rows = located(spark, path).where("trim(value) != ''")
    parsed = F.from_json("value", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = rows.withColumn("row", parsed)
    wrong = F.when(~F.startswith(F.ltrim("value"), F.lit("{")), "not an object").when(F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull(), "malformed")
    if key:
        name = F.trim(F.col(f"row.{key}").cast("string"))
        rows = rows.withColumn("name", F.when(F.coalesce(name, F.lit("")) != "", name))
        twice = F.row_number().over(Window.partitionBy("name").orderBy("file", "line")) > 1
        wrong = wrong.when(F.col("name").isNull(), f"no {key}").when(twice, f"repeated {key}")
    return rows.withColumn("wrong", wrong).withColumn("row", F.col("row").dropFields(_CORRUPT)).select("file", "line", "row", "wrong")


def bad_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """file, line, wrong of each line that is not a row."""
    return judged(spark, path, schema, key).where("wrong is not null").select("file", "line", "wrong")


def _place() -> Column:
    return F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.col("wrong"))


def checked(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """The rows; a line that is none is an error that names its file and number."""
    rows = judged(spark, path, schema, key)
    sound = F.when(F.col("wrong").isNull(), F.col("row")).otherwise(F.from_json(F.raise_error(_place()).cast("string"), schema))
    return rows.select(sound.alias("row")).select("row.*")

"""Places in a total order without a task that gets all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import kept


def ranked_rows(rows: DataFrame, *keys: str, name: str = "pos", nulls_first: bool = True) -> DataFrame:
    """rows with their place (from 0) in ascending order of keys, which should tell rows apart.

    Rows are dealt by range; the counts of the ranges, a row for each, give where each begins. The deal is kept: ranges follow
    from a sample, and one drawn anew for the counts would have other ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() if nulls_first else F.col(k).asc_nulls_last() for k in keys]
    dealt = kept(rows.repartitionByRange(n, *order).withColumn("_dealt", F.spark_partition_id()))
    sizes = dealt.groupBy("_dealt").agg(F.count("*").alias("_held"))
    begins = sizes.select("_dealt", (F.sum("_held").over(Window.orderBy("_dealt")) - F.col("_held")).alias("_dealt_from"))
    placed = dealt.withColumn("_in_dealt", F.row_number().over(Window.partitionBy("_dealt").orderBy(*order)) - 1)
    return placed.join(F.broadcast(begins), "_dealt").withColumn(name, F.col("_dealt_from") + F.col("_in_dealt")).drop("_dealt", "_in_dealt", "_dealt_from")

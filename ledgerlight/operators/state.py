"""State that rounds hand on: written to the folder that the cluster shares, so that a lost executor costs one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and read from a table in the shared folder from then on.

    A table rather than a checkpoint: a checkpoint hands on the estimated sizes of what it was made from, which joins of
    several rounds multiply to numbers that planning cannot handle, while a table's sizes are those of its files."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

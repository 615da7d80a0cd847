"""What a table holds, as one digest: the same however its rows are ordered, split into files or dealt to tasks.

A row is its canonical JSON, keys sorted at every depth, nulls kept. Rows' SHA-256 digests fall into 256 buckets by their first
byte; a bucket is its number of rows and the sums of its digests' four quarters, which tasks add up before anything is shuffled;
the root is the SHA-256 of the buckets' lines. Where a root differs, the buckets that differ name the rows to look at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def canonical(value: Column, kind: DataType) -> Column:
    """value with struct fields and map keys in order, at every depth."""
    if isinstance(kind, StructType):
        made = F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value"))))
    return value


def row_json(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"})


def buckets(rows: DataFrame) -> DataFrame:
    """bucket (two hex digits), rows, q0 to q3: at most 256 rows."""
    digest = rows.select(F.sha2(row_json(rows), 256).alias("d"))
    quarter = [F.sum(F.conv(F.substring("d", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    return digest.groupBy(F.substring("d", 1, 2).alias("bucket")).agg(F.count("*").alias("rows"), *quarter)


def root(parts: DataFrame) -> DataFrame:
    """rows, digest: one row over buckets(); an empty table has the digest of nothing."""
    line = F.concat_ws(":", "bucket", "rows", *[F.col(f"q{i}").cast("string") for i in range(4)])
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")  # of 256 buckets at most
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(lines, 256).alias("digest"))


def fingerprint(rows: DataFrame) -> dict:
    """rows, digest and the buckets' lines, as a manifest holds them."""
    lines = sorted([r["bucket"], r["rows"], *(str(r[f"q{i}"]) for i in range(4))] for r in buckets(rows).collect())
    total = root(rows.sparkSession.createDataFrame([(b, n, *q) for b, n, *q in lines], "bucket string, rows long, q0 string, q1 string, q2 string, q3 string"))
    one = total.first()
    return {"rows": one["rows"], "digest": one["digest"], "buckets": lines}


def drift(rows: DataFrame, known: dict) -> list[str]:
    """The buckets in which rows are not those of a fingerprint; none: nothing has changed."""
    now, then = ({b: x for b, *x in f["buckets"]} for f in (fingerprint(rows), known))
    return sorted(b for b in now.keys() | then.keys() if now.get(b) != then.get(b))


def request_digest(parts: dict) -> str:
    """SHA-256 of a request's canonical JSON, as candidates, runs and prompts are named."""
    import hashlib

    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def files(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each data file under path, by name."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    walk, out = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True), {}
    while walk.hasNext():
        f = walk.next()
        name = f.getPath().toString()
        if not f.getPath().getName().startswith(("_", ".")):
            out[name[name.rindex(folder.getName()) + len(folder.getName()) + 1 :]] = f.getLen()
    return out

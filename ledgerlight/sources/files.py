"""Readers with fixed schemas, and writers that publish a checked folder in one step."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flatten_json, normalize_text
from ..operators.catalog import attributes, document_frequency, folded_details, keyed_pairs, known_keyed_values, material_vocabulary, non_negative_int, optional_float, wilson_prior
from .fingerprint import files, fingerprint
from .lines import checked
from .schemas import CORPUS, OUTCOME, PRODUCT, SCHEMA_VERSION, TRACE

FIELDS = ("title", "categories", "features", "details", "store", "description")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are passed over, malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Normalized products: id, the text fields, details as ordered pairs, price, ratings, searchable_text, quality_prior.

    A missing id fails where it is read. Repeated ids are found by repeated_ids().
    """
    raw = read_jsonl(spark, path, PRODUCT)
    items = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    # one Python pass over joined text keeps the arrays: U+E000 parts items, U+E001 a key from its value, and normalization leaves them alone
    sep, mid = "\ue000", "\ue001"

    def normal(values):
        joined = normalize_text(F.array_join(F.transform(values, lambda x: F.translate(x, sep, " ")), f" {sep} "))
        return F.filter(F.transform(F.split(joined, sep), lambda x: F.trim(x)), lambda x: x != "")

    entries = F.filter(F.coalesce(F.map_entries("details"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    pairs = F.transform(normal(F.transform(entries, lambda e: F.concat(F.translate(e["key"], mid, " "), F.lit(f" {mid} "), F.translate(e["value"], mid, " ")))), lambda x: F.split(x, mid))
    said = normal(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], F.when(e["value"].rlike(r"^\s*[\[{]"), flatten_json(e["value"])).otherwise(e["value"]))))
    name = F.regexp_replace(F.coalesce("parent_asin", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = raw.select(
        F.when(name == "", F.raise_error(F.lit("a product has no id")).cast("string")).otherwise(name).alias("id"),
        normalize_text(F.coalesce("title", F.lit(""))).alias("title"),
        normal(items("categories")).alias("categories"), normal(items("features")).alias("features"),
        F.array_join(normal(items("description")), " ").alias("description"),
        F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value"))).alias("details"), F.array_join(said, " ").alias("details_text"),
        normalize_text(F.coalesce("store", F.lit(""))).alias("store"),
        optional_float(F.col("price")).alias("price"), optional_float(F.col("average_rating")).alias("average_rating"), non_negative_int(F.col("rating_number"), "rating_number").alias("rating_number"),
    )
    text = F.concat_ws(" ", *[F.when(x != "", x) for x in (F.col("title"), F.array_join("categories", " "), F.array_join("features", " "), F.col("details_text"), F.col("store"), F.col("description"))])
    return rows.withColumn("searchable_text", text).drop("details_text").withColumn("quality_prior", wilson_prior(F.col("average_rating"), F.col("rating_number")))


def repeated_ids(products: DataFrame) -> DataFrame:
    return products.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of sessions; a bad or repeated one is an error that names its file and line."""
    return checked(spark, path, OUTCOME, "sample_id")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TRACE)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark, path, CORPUS, "sample_id")


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a fixed order, keys sorted, over as many files as the order's ranges."""
    rows.select(*sorted(rows.columns)).orderBy(*order).write.mode("errorifexists").json(path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)) or not fs.rename(path(source), path(target)):
        fs.delete(path(source), True)
        raise FileExistsError(target)


def delete_folder(spark: SparkSession, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(target), True)


def build_artifacts(spark: SparkSession, catalog: str, target: str, df_mode: str = "weighted") -> dict:
    """The catalog's relations under target: products, attributes (by attribute), postings (sorted by term), terms, manifest.

    All is written beside the target, read back and checked, then renamed; a failure leaves nothing behind.
    """
    from ..operators.catalog import FIELD_WEIGHTS, weighted_postings

    staging = f"{target.rstrip('/')}.staging"
    delete_folder(spark, staging)
    try:
        read = read_catalog(spark, catalog)
        read.write.parquet(f"{staging}/read")
        read = spark.read.parquet(f"{staging}/read")
        known = read.select("id", F.explode("details").alias("d")).select("id", F.col("d.key").alias("attribute"), F.col("d.value").alias("value"))
        keyed = known_keyed_values(keyed_pairs(read))
        folded_details(read, material_vocabulary(known), keyed).select(*read.columns).write.parquet(f"{staging}/products")
        products = spark.read.parquet(f"{staging}/products")
        if (twice := repeated_ids(products).limit(1).collect()):
            raise ValueError(f"repeated product id {twice[0]['id']}")
        rows = attributes(products, {"category": "categories", "feature": "features"}, {"brand": "store", "budget": "price"}, "details")
        rows.repartition("attribute", "value").sortWithinPartitions("value").write.partitionBy("attribute").parquet(f"{staging}/attributes")
        flat = products.select(
            "id", "title", F.array_join("categories", " ").alias("categories"), F.array_join("features", " ").alias("features"), "store", "description",
            F.array_join(F.transform("details", lambda d: F.concat_ws(" ", d["key"], d["value"])), " ").alias("details"),
        )
        postings = weighted_postings(flat, FIELD_WEIGHTS)
        postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{staging}/postings")
        postings = spark.read.parquet(f"{staging}/postings")
        document_frequency(postings, df_mode).write.parquet(f"{staging}/terms")
        manifest = {
            "schema_version": SCHEMA_VERSION, "products": products.count(), "terms": spark.read.parquet(f"{staging}/terms").count(), "df_mode": df_mode,
            "field_weights": FIELD_WEIGHTS, "source": _named(spark.read.text(catalog)),
            "relations": {n: _named(spark.read.parquet(f"{staging}/{n}")) | {"bytes": files(spark, f"{staging}/{n}")} for n in RELATIONS},
        }
        delete_folder(spark, f"{staging}/read")
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
        open_artifacts(spark, staging)
    except Exception:
        delete_folder(spark, staging)
        raise
    _rename(spark, staging, target)
    return manifest


RELATIONS = ("products", "attributes", "postings", "terms")


def _named(rows: DataFrame) -> dict:
    return {k: v for k, v in fingerprint(rows).items() if k != "buckets"}


def open_artifacts(spark: SparkSession, path: str, catalog: str | None = None, deep: bool = False) -> dict[str, DataFrame]:
    """The relations by name; an error where the manifest does not describe them: their files by name and size, with a catalog
    the lines they were built from, and with deep every row."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {manifest['schema_version']}")
    for name in RELATIONS:
        if files(spark, f"{path}/{name}") != manifest["relations"][name]["bytes"]:
            raise ValueError(f"the files of {name} are not those of the manifest")
    if catalog is not None and _named(spark.read.text(catalog)) != manifest["source"]:
        raise ValueError("the catalog has changed since the artifacts were built")
    found = {name: spark.read.parquet(f"{path}/{name}") for name in RELATIONS}
    for name in RELATIONS if deep else ():
        if _named(found[name]) != {k: manifest["relations"][name][k] for k in ("rows", "digest")}:
            raise ValueError(f"the rows of {name} are not those of the manifest")
    if found["products"].count() != manifest["products"]:
        raise ValueError("the manifest counts other products")
    return found


def upsert(entries: DataFrame, entry: DataFrame, key: str = "name", digest: str = "sha256", refreeze: bool = False) -> DataFrame:
    """entries with entry in place of its namesake; a changed digest is refused unless refreeze."""
    if not refreeze:
        old = entries.select(key, F.col(digest).alias("_old"))
        changed = entry.join(old, key).where(F.col(digest) != F.col("_old")).limit(1).collect()
        if changed:
            raise ValueError(f"{changed[0][key]} has another digest")
    return entries.join(entry, key, "left_anti").unionByName(entry).orderBy(key)


def markdown_cell(value: object) -> str:
    """Six decimals, scientific below 1e-4, yes and no."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return "0.0" if value == 0 else f"{value:.4e}" if abs(value) < 1e-4 else f"{value:.6f}"
    return str(value).replace("|", "\\|")


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A report's rows as a table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(markdown_cell, r)) + " |" for r in rows.limit(limit).collect()]) + "\n"

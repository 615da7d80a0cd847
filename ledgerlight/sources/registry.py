"""A registry of corpora: data in folders that never change, and versions of the list of them, each written once.

A folder is written, read back, checked and fingerprinted before the registry names it; a folder that no version names is waste,
not a corpus. A new version is a file created only if it does not exist, so that of two writers who both read version n one writes
n + 1 and the other is refused. Nothing is renamed: on object stores a rename copies file by file. Whether creation is
atomic is the file system's affair: it is on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.profiles import corpus_violations
from .files import read_corpus, read_jsonl
from .fingerprint import drift, fingerprint
from .schemas import CORPUS


class Conflict(RuntimeError):
    """Another writer was first."""


def _fs(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, registry: str) -> list[int]:
    fs, folder = _fs(spark, f"{registry}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def entries(spark: SparkSession, registry: str) -> tuple[int, dict[str, dict]]:
    """The latest version and its corpora by name; version 0 has none. A corpus is a line, its rows are elsewhere."""
    known = versions(spark, registry)
    if not known:
        return 0, {}
    lines = spark.read.text(f"{registry}/versions/{known[-1]}").collect()
    return known[-1], {e["name"]: e for e in (json.loads(r["value"]) for r in lines)}


def commit(spark: SparkSession, registry: str, version: int, entry: dict, refreeze: bool = False) -> int:
    """A version after the given one with the entry in it; an entry whose digest would change is refused unless refreeze."""
    now, held = entries(spark, registry)
    if now != version:
        raise Conflict(f"the registry is at version {now}, not {version}")
    old = held.get(entry["name"])
    if old and old["digest"] != entry["digest"] and not refreeze:
        raise ValueError(f"{entry['name']} is frozen with another digest")
    text = "".join(json.dumps(e, sort_keys=True) + "\n" for _, e in sorted((held | {entry["name"]: entry}).items()))
    fs, path = _fs(spark, f"{registry}/versions/{version + 1}")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        raise Conflict(f"version {version + 1} was written by another") from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return version + 1


def publish(rows: DataFrame, registry: str, name: str, refreeze: bool = False) -> dict:
    """The registry's entry of rows, written as JSON lines in a folder of their own; refused where a row breaks a rule."""
    spark, version = rows.sparkSession, entries(rows.sparkSession, registry)[0]
    path = f"{registry}/data/{name}-{uuid.uuid4().hex}"
    rows.write.json(path)
    staged = read_jsonl(spark, path, CORPUS)
    if wrong := corpus_violations(staged).limit(3).collect():
        raise ValueError(f"{name} breaks rules: " + ", ".join(f"{r['sample_id']}: {r['violation']}" for r in wrong))
    entry = {"name": name, "path": path, **fingerprint(staged)}
    commit(spark, registry, version, entry, refreeze)
    return entry


def resolve(spark: SparkSession, registry: str, name: str) -> DataFrame:
    """The corpus of a name, if its rows are still those that were registered."""
    held = entries(spark, registry)[1]
    if name not in held:
        raise KeyError(f"no corpus named {name}; there are {sorted(held)}")
    rows = read_corpus(spark, held[name]["path"])
    if moved := drift(rows, held[name]):
        raise ValueError(f"{name} has changed since it was registered, in buckets {moved[:5]}")
    return rows

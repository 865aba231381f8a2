"""What is kept between runs: index tables, signatures, feedback cases and profiles."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2


def index_key(source_id: str, options: dict) -> str:
    """The identity of an index: a digest of its version, source and options."""
    return hashlib.sha256(json.dumps([VERSION, source_id, options], sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    """The file system of a path, which may be that of a cluster, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """The complete versions of an index, oldest first; the marker is written last."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return [n for n in names if n.startswith("v") and fs.exists(_files(spark, f"{folder}/{n}/{MARKER}")[1])]


MARKER = "complete.json"


def save_tables(tables: dict[str, DataFrame], folder: str, identity: str = "") -> str:
    """Write the tables as a new version of the index; the versions before it go once it is complete.

    A failure leaves the old version and is raised.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns():020d}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    old = _versions(spark, folder)
    fs, marker = _files(spark, f"{folder}/{version}/{MARKER}")
    out = fs.create(marker, True)
    out.write(bytearray(json.dumps({"version": VERSION, "identity": identity, "tables": sorted(tables), "built_at": time.time()}).encode()))
    out.close()
    for name in old:
        fs.delete(_files(spark, f"{folder}/{name}")[1], True)
    return version


def load_tables(spark: SparkSession, folder: str, identity: str = "") -> dict[str, DataFrame] | None:
    """The tables of the last complete version, or None if there is none of this format and identity."""
    for name in reversed(_versions(spark, folder)):
        meta = json.loads("".join(r.value for r in spark.read.text(f"{folder}/{name}/{MARKER}", wholetext=True).collect()))
        if meta.get("version") == VERSION and meta.get("identity") == identity:
            return {n: spark.read.parquet(f"{folder}/{name}/{n}") for n in meta["tables"]}
    return None


def signature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, status)`` of paths that were added, removed or changed; an empty result means fresh."""
    b, a = before.select("path", F.struct("len", "modified_ns").alias("b")).distinct(), after.select("path", F.struct("len", "modified_ns").alias("a")).distinct()
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def folder_summary(folder: str) -> dict[str, int]:
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs]
    entries = sum(e.is_dir() for e in os.scandir(folder)) if os.path.isdir(folder) else 0
    return {"entries": entries, "files": len(sizes), "bytes": sum(sizes)}


def clean(folder: str, force: bool = False) -> bool:
    if force and os.path.isdir(folder):
        shutil.rmtree(folder)
        return True
    return False


def append_feedback(path: str, query: str, expected: str, note: str = "") -> dict:
    case = {"id": uuid.uuid4().hex, "query": query, "expected": expected, "note": note, "created_ms": int(time.time() * 1000)}
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(case) + "\n")
    return case


def list_feedback(spark: SparkSession, path: str, limit: int) -> tuple[list, int]:
    """The newest cases and the number of all."""
    if not os.path.exists(path):
        return [], 0
    cases = spark.read.schema("id string, query string, expected string, note string, created_ms bigint").json(path)
    return cases.orderBy(F.desc("created_ms"), "id").limit(limit).collect(), cases.count()


class Profiles:
    """Named settings in one JSON file, replaced by name and written by rename."""

    def __init__(self, path: str) -> None:
        self.path = path

    def all(self) -> dict[str, dict]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def save(self, name: str, settings: dict) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
            raise ValueError("a profile's name has letters, digits, dots, dashes and underscores")
        self._write(self.all() | {name: settings})

    def delete(self, name: str) -> bool:
        left = self.all()
        found = left.pop(name, None) is not None
        self._write(left)
        return found

    def _write(self, profiles: dict[str, dict]) -> None:
        with open(f"{self.path}.tmp", "w", encoding="utf-8") as f:
            json.dump(dict(sorted(profiles.items())), f)
        os.replace(f"{self.path}.tmp", self.path)


def resolve(defaults: dict, *layers: dict) -> dict:
    """Settings by precedence: later layers hold, where they say anything."""
    out = dict(defaults)
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    return out

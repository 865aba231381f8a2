"""Evaluation tasks from files: repositories and the queries annotated with what they should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECS = "name string, language string, url string, revision string, benchmark_root string"
TARGET = "struct<path:string,start_line:string,end_line:string>"


def load_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row per repository of a JSON list."""
    return spark.read.schema(SPECS).json(path, multiLine=True)


def load_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """``(task_id, repo, query, category, targets)`` of all annotation files of a folder, each a JSON list.

    Targets are the relevant and then the secondary ones, ``(path, start_line, end_line)``; a target may be a text, which is
    a path alone, and line numbers may be texts.  A task without a repo belongs to the one that its file is named after,
    one without a category to that of its query.
    """
    raw = spark.read.schema("query string, relevant array<string>, secondary array<string>, category string, repo string").json(f"{folder}/*.json", multiLine=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:[.][^.]*)?$", 1)
    nothing = F.expr("cast(array() as array<string>)")

    def parsed(t):
        made = F.from_json(t, TARGET.replace("struct<", "").rstrip(">").replace(":", " "))
        line = lambda n: F.expr("null").cast("bigint") if n is None else n.cast("bigint")
        named = made.getField("path")
        return F.struct(F.coalesce(named, t).alias("path"), line(made.getField("start_line")).alias("start_line"), line(made.getField("end_line")).alias("end_line"))

    category = F.when(~F.col("query").contains(" "), "symbol").when(F.lower("query").startswith("how "), "architecture").otherwise("semantic")
    made = raw.select(
        F.coalesce("repo", name).alias("repo"), "query", F.coalesce("category", category).alias("category"),
        F.transform(F.concat(F.coalesce("relevant", nothing), F.coalesce("secondary", nothing)), parsed).alias("targets"),
    )
    return made.where("query is not null").withColumn("task_id", F.xxhash64("repo", "query"))


def same_path(a: str, b: str) -> bool:
    """Equal, or one ends with the other; a backslash counts as a slash."""
    a, b = a.replace("\\", "/"), b.replace("\\", "/")
    return a == b or a.endswith(f"/{b}") or b.endswith(f"/{a}")


def meets(hit, target) -> bool:
    """Whether a hit is what a target means: the path, and lines that overlap where the target names both."""
    return same_path(hit.file_path, target.path) and (target.start_line is None or target.end_line is None or not (hit.end_line < target.start_line or hit.start_line > target.end_line))


def label(target) -> str:
    return target.path if target.start_line is None or target.end_line is None else f"{target.path}:{target.start_line}-{target.end_line}"


def marked(hits: list, targets: list) -> list[bool]:
    """Of every hit whether any target means it."""
    return [any(meets(h, t) for t in targets) for h in hits]


def target_rank(hits: list, target) -> int | None:
    """The place of the first hit that a target means."""
    return next((i for i, h in enumerate(hits, 1) if meets(h, target)), None)

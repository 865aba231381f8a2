"""Problem 7: occurrences and record counts of every term, kept up by signed deltas.

State is one row per term, ``(term, occurrences, records)``.  A batch of added, changed or deleted postings becomes signed
per-term changes; merging adds them to the state and drops terms that no record holds any more.  Nothing that has not
changed is read again except the state itself.  ``CountStore`` keeps the state as a table in buckets of the term's hash:
a merge joins bucket with bucket, so only the delta is shuffled and each task reads and writes one bucket.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.packed import term_totals
from quern.llm.tables import write_bucketed
from quern.session import checkpoint_dir

#: A term that fewer records hold is ``rare``; one that more than this share of the records hold is ``common``.
RARE_BELOW = 3
COMMON_ABOVE = 0.30

COUNTS = "term string, occurrences bigint, records bigint"


def clean_term(term: Column) -> Column:
    """Trimmed and lower-cased; null for a null, empty or blank term."""
    return F.nullif(F.lower(F.trim(term)), F.lit(""))


def distinct_postings(postings: DataFrame) -> DataFrame:
    """``(term, chunk_id, tf)``, one row per cleaned term and chunk.

    Repeated rows count once; where they disagree the largest tf holds.  A null tf means that the chunk holds the term
    an unknown number of times and counts as one.  Rows without a term or a chunk are left out.  The key is the pair,
    so a term that a third of the rows share is still spread over all tasks.
    """
    rows = postings.select(clean_term(F.col("term")).alias("term"), F.col("chunk_id"), F.coalesce(F.col("tf"), F.lit(1)).alias("tf"))
    rows = rows.where(F.col("term").isNotNull() & F.col("chunk_id").isNotNull())
    return rows.groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"))


def term_deltas(postings: DataFrame, sign: int, rows: int | None = None) -> DataFrame:
    """Signed per-term changes of a batch of postings: ``sign`` is 1 for rows that came in, -1 for rows that went.

    ``rows`` is about the batch's number of rows, as in ``term_totals``.
    """
    if sign not in (1, -1):
        raise ValueError("sign must be 1 or -1")
    totals = term_totals(postings, rows)
    return totals if sign == 1 else totals.select("term", (-F.col("occurrences")).alias("occurrences"), (-F.col("records")).alias("records"))


def batch_deltas(added: DataFrame | None = None, changed: tuple[DataFrame, DataFrame] | None = None, deleted: DataFrame | None = None, rows: int | None = None) -> list[DataFrame]:
    """The signed changes of one batch.

    ``changed`` is a pair of the old and the new postings of the same records.  A batch is taken by whole records: the
    postings of a record are all in one batch, else a repeated row could count twice.
    """
    old, new = changed or (None, None)
    batches = ((added, 1), (deleted, -1), (old, -1), (new, 1))
    return [term_deltas(df, sign, rows) for df, sign in batches if df is not None]


def merge_counts(counts: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The state after the deltas.  Terms whose record count falls to zero go.  No state means an empty one."""
    parts = [d.select("term", "occurrences", "records") for d in (*([counts] if counts is not None else []), *deltas)]
    if not parts:
        raise ValueError("neither counts nor deltas")
    if len(parts) == 1:
        return parts[0].where("records > 0")
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .where("records > 0")
    )


def update_counts(
    counts: DataFrame | None, added: DataFrame | None = None, changed: tuple[DataFrame, DataFrame] | None = None, deleted: DataFrame | None = None
) -> DataFrame:
    """``batch_deltas`` merged into a state that is not stored."""
    return merge_counts(counts, *batch_deltas(added, changed, deleted))


class CountStore:
    """The persistent state: a table in ``buckets`` buckets of the term, sorted by it, in a folder of its own per version.

    A merge writes the next version beside the last and then takes its place, so a lost executor or a failed merge leaves
    the state as it was.  ``folder`` must be shared by all executors; it is one under ``spark.checkpoint.dir`` by default.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.name = f"quern_counts_{uuid.uuid4().hex}"
        self.folder = (folder or f"{checkpoint_dir(spark).rstrip('/')}/{self.name}").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.version = -1

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int, buckets: int) -> CountStore:
        """A stored version, as by an earlier session."""
        store = cls(spark, folder, buckets)
        store.version = version
        spark.sql(f"CREATE TABLE {store._table(version)} (term STRING, occurrences BIGINT, records BIGINT) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{store.folder}/v{version}'")
        return store

    def _table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def read(self) -> DataFrame:
        """``(term, occurrences, records)`` of the last version; no rows before the first merge."""
        return self.spark.table(self._table(self.version)) if self.version >= 0 else self.spark.createDataFrame([], COUNTS)

    def apply(self, added: DataFrame | None = None, changed: tuple[DataFrame, DataFrame] | None = None, deleted: DataFrame | None = None, rows: int | None = None) -> CountStore:
        """Merge one batch of postings."""
        delta = merge_deltas(batch_deltas(added, changed, deleted, rows))
        if self.version < 0:
            merged = delta.where("records > 0")
        else:
            old = self.read().select("term", F.col("occurrences").alias("_o"), F.col("records").alias("_r"))
            added_up = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            merged = (
                old.join(delta.repartition(self.buckets, "term"), "term", "full_outer")
                .select("term", added_up("_o", "occurrences").alias("occurrences"), added_up("_r", "records").alias("records"))
                .where("records > 0")
            )
        step = self.version + 1
        write_bucketed(merged, "term", self.buckets, f"{self.folder}/v{step}", self._table(step))
        self.version = step
        return self


def merge_deltas(deltas: list[DataFrame]) -> DataFrame:
    """One signed change per term.  Unlike in a state a change may be zero or negative."""
    if not deltas:
        raise ValueError("no batch")
    if len(deltas) == 1:
        return deltas[0]
    return reduce(DataFrame.unionByName, deltas).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, records: int | Column, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Adds ``mark``: ``rare``, ``common`` or null.  ``records`` is the number of records in the collection.

    A term that is both (in a tiny collection) is ``rare``.
    """
    total = F.lit(records) if isinstance(records, int) else records
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common")
    return counts.withColumn("mark", mark)

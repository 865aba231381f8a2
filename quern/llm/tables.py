"""Intermediate tables in buckets, so that what is joined again and again is shuffled once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quern.session import stored, work_folder

__all__ = ["bucket_number", "bucketed", "stored", "write_bucketed"]


def bucket_number(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def write_bucketed(df: DataFrame, by: str, buckets: int, folder: str, name: str, placed: bool = False) -> DataFrame:
    """Write ``df`` as the table ``name`` in ``buckets`` buckets of ``by``, sorted by it; one file per bucket.

    ``placed`` says that the rows lie so already, by a ``repartition(buckets, by)``.
    """
    (df if placed else df.repartition(buckets, by)).write.bucketBy(buckets, by).sortBy(by).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed(df: DataFrame, by: str, placed: bool = False) -> DataFrame:
    """``df`` written in buckets of ``by`` in the shared folder: a join on ``by`` reads them without a shuffle."""
    name = f"quern_{uuid.uuid4().hex}"
    return write_bucketed(df, by, bucket_number(df), f"{work_folder(df.sparkSession)}/{name}", name, placed)

"""Places within ordered groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut


def _places(by: str, carried: dict[int, int]):
    """Adds the place of each row in its group, from rows sorted by group; a range's first group goes on from ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, at = batch.column(by), batch.schema.get_field_index("_range")
            coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]]))
            places = np.arange(n) - np.repeat(first, np.diff([*first, n])) + 1
            if last is None:
                held = carried.get(batch.column(at)[0].as_py(), 0)
            elif last != (keys[0].as_py(),):
                held = 0
            head = first[1] if len(first) > 1 else n
            places[:head] += held
            last, held = (keys[n - 1].as_py(),), int(places[-1])
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(places)], names=[*(x for x in batch.schema.names if x != "_range"), "_place"])

    return run


def numbered(df: DataFrame, by: str, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: the place of each row, from 1, within the rows of its ``by``, as ``row_number`` gives it.

    The rows are sorted in ranges over all tasks, so a group that holds a third of all rows lies in many of them.  A row's
    place is that within its range plus what the ranges before it hold of the group; only a range's first group can have
    begun before it, so the driver needs one count per range.  ``order`` must leave no ties that matter; rows with a
    null ``by`` are a group too.
    """
    # Ranges are sampled first, so what leads to the rows is written once before.
    ranges = cut(cut(df).repartitionByRange(by, *order).sortWithinPartitions(by, *order)).withColumn("_range", F.spark_partition_id())
    group = F.struct(F.col(by))
    ends = ranges.groupBy("_range").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.count(F.lit(1)).alias("n"))
    tails = ranges.join(F.broadcast(ends.select(F.col("_range").alias("_r"), "last")), (F.col("_range") == F.col("_r")) & (group == F.col("last")))
    held = {r["_range"]: r.n for r in tails.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    carried, before = {}, None
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):
        if before is not None and before.last == r["first"]:
            carried[r["_range"]] = held[before["_range"]] + (carried.get(before["_range"], 0) if before["first"] == before.last else 0)
        before = r
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ranges.mapInArrow(_places(by, carried), f"{fields}, _place bigint").withColumnRenamed("_place", name)

"""Exact nearest vectors of a stated set of queries against all rows, as block products.

Queries and rows meet by a key: every row goes to one of ``parts`` places, every query to all of them, in blocks of at
most ``BLOCK`` queries.  A place holds one block's matrix and its best rows so far, takes the rows batch by batch and
gives at most k rows per query.  Nothing passes through the driver, and the plan does not grow with the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from quern.plans.runner import Run

#: Queries of one block, about: its matrix and its best rows are what a place holds.
BLOCK = 2048

#: Queries of a block whose scores are held at once, and those of one batch of rows that a place gives.
SCORED, GIVEN = 256, 256

#: Best rows of a place: scores are whole units of their last digit.
BEST = "query_id bigint, pool bigint, ids array<bigint>, units array<bigint>"

QUERY = "query_id bigint, v array<double>, k bigint, languages array<string>, paths array<string>"


def _best_rows(digits: int):
    """``BEST`` rows: per place and query the k best rows by rounded product, ties to the smaller id.

    The rows of a place are sorted with the queries first: (place, kind, id, v, k, languages, paths, language, path).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asked, block = None, [], None
        for batch in batches:
            places, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if places[a] != place:
                    if block is not None:
                        yield from block.best()
                    place, asked, block = places[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    asked.append(part)
                    continue
                if not asked:
                    continue
                if block is None:
                    block = _Block(pa.Table.from_batches(asked), digits)
                block.take(part)
        if block is not None:
            yield from block.best()

    return run


class _Block:
    """The queries of a block and their best rows so far: all that reach the k-th best score, and some more until they are cut."""

    def __init__(self, asked: pa.Table, digits: int) -> None:
        self.queries, self.limits, self.unit = asked.column(2).to_numpy(), asked.column(4).to_numpy(), 10.0**digits
        self.matrix = np.stack(asked.column(3).to_pylist()).astype(np.float64)
        self.filters = [[set(x) - {None} if x else None for x in asked.column(c).to_pylist()] for c in (5, 6)]
        self.edges = np.full(len(self.matrix), -np.inf)
        self.ids: list[list[np.ndarray]] = [[] for _ in self.queries]
        self.units: list[list[np.ndarray]] = [[] for _ in self.queries]
        self.held = np.zeros(len(self.queries), dtype=np.int64)

    def take(self, part: pa.RecordBatch) -> None:
        keys = part.column(2).to_numpy()
        rows = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        values = [part.column(c).to_pylist() if any(w is not None for w in wanted) else None for c, wanted in zip((7, 8), self.filters)]
        masks: dict[tuple, np.ndarray] = {}
        for a in range(0, len(self.matrix), SCORED):
            units = self.matrix[a : a + SCORED] @ rows.T
            units *= self.unit
            np.rint(units, out=units)
            for q, own in enumerate(units, a):
                at = np.flatnonzero(own >= self.edges[q])
                for c, (wanted, known) in enumerate(zip(self.filters, values)):
                    if wanted[q] is not None:
                        which = (c, frozenset(wanted[q]))
                        if which not in masks:
                            masks[which] = np.array([v in wanted[q] for v in known], dtype=bool)
                        at = at[masks[which][at]]
                if len(at):
                    self.ids[q].append(keys[at])
                    self.units[q].append(own[at].astype(np.int64))
                    self.held[q] += len(at)
                    if self.held[q] > 2 * self.limits[q]:
                        self._cut(q)

    def _cut(self, q: int) -> None:
        ids, units, k = np.concatenate(self.ids[q]), np.concatenate(self.units[q]), int(self.limits[q])
        if len(ids) > k:
            edge = np.partition(units, len(units) - k)[len(units) - k]
            above, same = np.flatnonzero(units > edge), np.flatnonzero(units == edge)
            at = np.concatenate([above, same[np.argsort(ids[same])[: k - len(above)]]])
            ids, units, self.edges[q] = ids[at], units[at], edge
        self.ids[q], self.units[q], self.held[q] = [ids], [units], len(ids)

    def best(self) -> Iterator[pa.RecordBatch]:
        found = []
        for q in np.flatnonzero(self.held):
            self._cut(q)
            found.append((self.queries[q], self.limits[q], self.ids[q][0], self.units[q][0]))
            if len(found) >= GIVEN:
                yield best_batch(found)
                found = []
        if found:
            yield best_batch(found)


def best_batch(found: list[tuple]) -> pa.RecordBatch:
    q, limits, ids, units = zip(*found)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(np.int64))) for x in (ids, units)]
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(limits, pa.int64()), *lists], names=["query_id", "pool", "ids", "units"])


def best_of_places(best: DataFrame, digits: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the best rows of every query from those of the places, as many as its pool."""
    unit = 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = (batch.column(c) for c in ("ids", "units"))
            found = []
            for i, (q, pool) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("pool").to_pylist())):
                own, scores = ids[i].values.flatten().to_numpy(), units[i].values.flatten().to_numpy()
                order = np.lexsort((own, -scores))[:pool]
                found.append((np.full(len(order), q), own[order], scores[order] / unit, np.arange(1, len(order) + 1, dtype=np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "id", "score", "rank"])

    gathered = best.groupBy("query_id").agg(F.max("pool").alias("pool"), F.collect_list("ids").alias("ids"), F.collect_list("units").alias("units"))
    return gathered.mapInArrow(run, "query_id bigint, id bigint, score double, rank int")


def top_products(vectors: DataFrame, queries: DataFrame, asked: int, by: str | None = None, digits: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the k best rows of every query by rounded product, ties to the smaller id.

    ``vectors`` are ``(id, v, language, path)`` with unit vectors, ``queries`` as in ``QUERY`` and, where rows are only
    compared within a value of it, the column ``by`` in both.  A null or empty list of languages or paths takes all.
    ``asked`` is the number of queries, for the number of blocks.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = max(1, math.ceil(asked / BLOCK))
    within = F.col(by) if by else F.lit(0)
    spot = lambda block, part: F.xxhash64(within, block, part)
    nothing = F.lit(None).cast("array<string>")
    q = queries.withColumn("_block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = q.select(spot(F.col("_block"), F.col("_part")).alias("place"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), "v", "k", "languages", "paths", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("path"))
    v = vectors.withColumn("_part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = v.select(spot(F.col("_block"), F.col("_part")).alias("place"), F.lit(1).alias("kind"), "id", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("bigint").alias("k"), nothing.alias("languages"), nothing.alias("paths"), "language", "path")
    met = left.unionByName(right).repartition("place").sortWithinPartitions("place", "kind")
    return best_of_places(met.mapInArrow(_best_rows(digits), BEST), digits)


def dense_rows(spread: DataFrame, key: str, dimensions: int) -> DataFrame:
    """``(key, v)``: unit vectors from the components ``(key, i, v)`` that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, places, weights = batch.column(1), batch.column(1).values.field(0).to_numpy(), batch.column(1).values.field(1).to_numpy()
            ends = lists.offsets.to_numpy()
            v = np.zeros((batch.num_rows, dimensions))
            v[np.repeat(np.arange(batch.num_rows), np.diff(ends)), places[ends[0] : ends[-1]]] = weights[ends[0] : ends[-1]]
            norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v /= np.where(norms > 0, norms, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dimensions, dtype=np.int32), v.ravel())], names=[key, "v"])

    parts = spread.groupBy(key).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("v").cast("double").alias("x"))).alias("p"))
    return parts.mapInArrow(run, f"{key} bigint, v array<double>")


def block_hits(run: Run) -> DataFrame:
    """``dense_hits`` by block products, of hashed tokens or of the vectors that the run's encoder makes."""
    from quern.operators.encoders import encode_texts
    from quern.operators.postings import unit_chunks
    from quern.plans.stages import DIMENSIONS

    keys = run.stage("chunk_keys").select("chunk_id", "language", F.col("file_path").alias("path"))
    if run.encoder is not None:
        chunk_rows, query_rows = run.done["encoded_chunks"], encode_texts(run.stage("query_rows"), run.encoder, "query_id", "query_text")
    else:
        # Where no index keeps the components, they are not written to be gathered again.
        chunk_rows = dense_rows(run.stage("chunk_vectors"), "chunk_id", DIMENSIONS) if "chunk_vectors" in run.done else unit_chunks(run)
        query_rows = dense_rows(run.stage("query_vectors"), "query_id", DIMENSIONS)
    vectors = chunk_rows.join(keys, "chunk_id").select(F.col("chunk_id").alias("id"), "v", "language", "path")
    rows = run.stage("query_rows").select("query_id", F.col("pool").alias("k"), F.col("filter_languages").alias("languages"), F.col("filter_paths").alias("paths"))
    queries = query_rows.join(rows, "query_id")
    hits = top_products(vectors, queries, rows.count())
    limits = rows.select("query_id", "k")
    return hits.join(limits, "query_id").where("rank <= k").select("query_id", F.col("id").alias("chunk_id"), "score", "rank")

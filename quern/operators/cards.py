"""``file_card_candidates`` of a batch of queries, as counts over the terms that files are known by.

Files go to places by their path, queries to all places; a place gives at most as many files per query as can be among its
best, so that no row is made for a query and a file before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from quern.plans.runner import Run

#: Files of a query.
FILES = 32
NEVER = np.iinfo(np.int64).max
CARDS = "query_id bigint, chunk_id bigint, overlap bigint, file_path string"


def _best_cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    asked, rows = [], []
    for batch in batches:
        queries = batch.column("query").is_valid()
        asked.append(batch.filter(queries))
        rows.append(batch.filter(pa.compute.invert(queries)))
    if not asked:
        return
    asked, rows = pa.Table.from_batches(asked), pa.Table.from_batches(rows).combine_chunks()
    if not asked.num_rows or not rows.num_rows:
        return
    coded = rows.column("path").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    by_name = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), dtype=np.int64)
    place[by_name] = np.arange(len(names))
    names = [names[i] for i in by_name]
    file, ids = place[coded.indices.to_numpy()], rows.column("id").to_numpy()
    cards = rows.column("card").combine_chunks()
    of = np.repeat(file, np.diff(cards.offsets.to_numpy()))
    pairs = np.unique(cards.flatten().to_numpy().astype(np.int64) * len(names) + of)
    codes, of = np.divmod(pairs, len(names))
    ends = dict(zip(*np.unique(codes, return_index=True)))
    stops = dict(zip(*(x[::-1] for x in np.unique(codes[::-1], return_index=True)))) if len(codes) else {}
    held = lambda code: of[ends[code] : len(of) - stops[code]] if code in ends else of[:0]
    languages, firsts = np.array(rows.column("language").to_pylist(), dtype=object), {}

    def first_chunks(wanted: tuple, paths: tuple) -> np.ndarray:
        """The first chunk of every file that passes a filter."""
        if (wanted, paths) not in firsts:
            if len(firsts) > 100:
                firsts.clear()
            kept = np.ones(len(ids), dtype=bool)
            if wanted:
                kept &= np.isin(languages.astype(str), [x for x in wanted if x is not None]) & (languages != None)  # noqa: E711
            if paths:
                known = set(paths)
                kept &= np.array([n in known for n in names], dtype=bool)[file]
            firsts[wanted, paths] = first = np.full(len(names), NEVER)
            np.minimum.at(first, file[kept], ids[kept])
        return firsts[wanted, paths]

    out: list[tuple] = []
    for q, terms, wanted, paths in zip(*(asked.column(c).to_pylist() for c in ("query", "terms", "languages", "paths"))):
        overlap, in_path = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        for t in terms:
            # A file's path is that of all its chunks, so no file has a term both ways.
            by_path = held(2 * t + 1)
            in_path[by_path] = True
            overlap[by_path] += 1
            overlap[held(2 * t)] += 1
        first = first_chunks(tuple(wanted or ()), tuple(paths or ()))
        at = np.flatnonzero(in_path & (first != NEVER))
        at = at[np.argsort(-overlap[at], kind="stable")[:FILES]]
        out += [(q, int(first[a]), int(overlap[a]), names[a]) for a in at]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["query_id", "chunk_id", "overlap", "file_path"])


def card_candidates(run: Run, bags: DataFrame, codes: DataFrame, places: int) -> DataFrame:
    """``(query_id, chunk_id, part)``."""
    from quern.plans.stages import RRF

    few = run.stage("corpus_stats").select((F.col("n_chunks") <= 1500).alias("few"))
    asking = run.stage("query_rows").crossJoin(F.broadcast(few)).where("is_file_card OR (is_broad AND few)").select("query_id", "filter_languages", "filter_paths")
    terms = run.stage("query_terms").where("length(term) >= 3").join(codes, "term").groupBy("query_id").agg(F.collect_list("code").alias("terms"))
    asked = asking.join(terms, "query_id").selectExpr(f"explode(sequence(0, {places - 1})) as place", "query_id as query", "terms", "filter_languages as languages", "filter_paths as paths")
    keys = run.stage("chunk_keys").selectExpr("chunk_id as id", "file_path as path", "language")
    files = bags.select("id", "card").join(keys, "id").withColumn("place", F.pmod(F.xxhash64("path"), F.lit(places)).cast("int"))
    met = asked.unionByName(files, allowMissingColumns=True).repartitionById(places, F.col("place")).drop("place")
    met.mapInArrow(_best_cards, CARDS).createOrReplaceTempView(f"{run.prefix}cards")
    return run.spark.sql(f"SELECT query_id, chunk_id, CAST(0.5 * overlap / ({RRF} + n) AS DOUBLE) AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, file_path) AS n FROM {run.prefix}cards) x WHERE n <= {FILES}")

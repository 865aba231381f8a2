"""Exact BM25 hits of a batch of queries, as sums over the postings of its terms, and with them, where a batch asks for
both, its dense hits, as products with the vectors of the same chunks.

Chunks go to places by their id, every query to all places.  A place adds up one query at a time over all its chunks, so
that no row is made for a query and a chunk before it is known to be among the query's best, and gives at most as many
rows per query as its pool; the places' rows are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dense import BEST, GIVEN, best_batch, best_of_places
from quern.operators.postings import chunk_bags, unpacked_vectors
from quern.session import cut, stored

if TYPE_CHECKING:
    from quern.plans.runner import Run

#: Chunks of one place, about: their postings are what a place holds.
PLACE = 40_000
#: Up to so many distinct terms a batch is brought to the postings, beyond them both are shuffled.
BROUGHT = 1_000_000
#: Scores are kept as whole millionths, as they are rounded to six digits.
UNIT = 1e6

PACKED = "id bigint, n bigint, codes array<int>, tfs array<int>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, n, code, tf)`` with those of a chunk that follow each other as one; a chunk may give several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [batch.num_rows]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), batch.column(i)) for i in (2, 3)]
        first = pa.array(edges[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), *lists], names=["id", "n", "codes", "tfs"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many chunks of a batch hold each term."""
    for batch in batches:
        counts = np.bincount(batch.column(0).flatten().to_numpy())
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["code", "df"])


class _Place:
    """The postings of a place by term, and what its chunks are filtered by."""

    def __init__(self, postings: list[pa.RecordBatch], keys: list[pa.RecordBatch], asked: pa.Table) -> None:
        own = [b.column("id").to_numpy() for b in postings]
        self.ids = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.int64)
        lengths = np.zeros(len(self.ids))
        rows, codes, tfs = [], [], []
        for b, ids in zip(postings, own):
            at = np.searchsorted(self.ids, ids).astype(np.int32)
            lengths[at] = b.column("n").to_numpy()
            rows.append(np.repeat(at, np.diff(b.column("codes").offsets.to_numpy())))
            codes.append(b.column("codes").flatten().to_numpy())
            tfs.append(b.column("tfs").flatten().to_numpy())
        postings.clear()
        codes = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32)
        order = np.argsort(codes, kind="stable")
        self.rows = np.concatenate(rows)[order] if rows else codes
        tfs = np.concatenate(tfs)[order] if tfs else codes
        codes = codes[order]
        del order, rows
        terms, weights = asked.column("codes").combine_chunks().flatten().to_numpy(), asked.column("idfs").combine_chunks().flatten().to_numpy()
        idf = np.zeros(max(terms.max(initial=-1), codes.max(initial=-1)) + 1)
        idf[terms] = weights
        self.starts = np.searchsorted(codes, np.arange(len(idf) + 1))
        about = 1.5 * (0.25 + 0.75 * lengths / max(asked.column("mean")[0].as_py(), 1.0))
        self.weights = np.empty(len(codes))
        for a in range(0, len(codes), 1_000_000):
            s = slice(a, a + 1_000_000)
            self.weights[s] = idf[codes[s]] * tfs[s] * 2.5 / (tfs[s] + about[self.rows[s]])
        #: A term of many of the chunks is added as a whole column.
        self.columns: dict[int, np.ndarray] = {}
        self.keys, self.masks = keys, {}

    def add(self, total: np.ndarray, code: int) -> None:
        a, b = self.starts[code], self.starts[code + 1]
        if 8 * (b - a) > len(total) and (code in self.columns or len(self.columns) < 200):
            if code not in self.columns:
                self.columns[code] = np.zeros(len(total))
                self.columns[code][self.rows[a:b]] = self.weights[a:b]
            total += self.columns[code]
        elif b > a:
            total[self.rows[a:b]] += self.weights[a:b]

    def allowed(self, column: str, wanted: list) -> np.ndarray:
        """The chunks whose language or path is among those wanted."""
        known = (column, tuple(wanted))
        if known not in self.masks:
            if len(self.masks) > 100:
                self.masks.clear()
            self.masks[known] = mask = np.zeros(len(self.ids), dtype=bool)
            values = pa.array([w for w in wanted if w is not None], pa.string())
            for b in self.keys:
                ids = b.column("id").filter(pa.compute.is_in(b.column(column), value_set=values)).to_numpy()
                at = np.searchsorted(self.ids, ids)
                at, ids = at[at < len(self.ids)], ids[at < len(self.ids)]
                mask[at[self.ids[at] == ids]] = True
        return self.masks[known]


def _best(batches: Iterator[pa.RecordBatch], places: list[_Place] | None = None) -> Iterator[pa.RecordBatch]:
    """Per query of a place the best rows, as many as its pool, ties to the smaller id; ``places`` gets the place."""
    by_kind: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for k, rows in enumerate(by_kind):
            if (kinds == k).any():
                rows.append(batch if (kinds == k).all() else batch.filter(pa.array(kinds == k)))
    asked, postings, keys = by_kind
    if not asked or not postings:
        return
    queries = pa.Table.from_batches(asked)
    place = _Place(postings, keys, queries)
    if places is not None:
        places.append(place)
    total, out = np.zeros(len(place.ids)), []
    for batch in asked:
        query, pools, languages, paths = (batch.column(c).to_pylist() for c in ("id", "n", "languages", "paths"))
        ends, codes = batch.column("codes").offsets.to_numpy(), batch.column("codes").values.to_numpy()
        for i, q in enumerate(query):
            total[:] = 0
            for c in codes[ends[i] : ends[i + 1]]:
                place.add(total, int(c))
            for column, wanted in (("language", languages[i]), ("path", paths[i])):
                if wanted:
                    total *= place.allowed(column, wanted)
            at, units = best_sums(total, pools[i])
            if len(at):
                out.append((q, pools[i], place.ids[at], units))
            if len(out) >= GIVEN:
                yield best_batch(out)
                out = []
    if out:
        yield best_batch(out)


def _first(units: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest, ties to the first."""
    if len(units) <= k:
        return np.arange(len(units))
    edge = np.partition(units, len(units) - k)[len(units) - k]
    above = np.flatnonzero(units > edge)
    return np.concatenate([above, np.flatnonzero(units == edge)[: k - len(above)]])


def best_sums(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k largest sums and the sums in units, ties in units to the first."""
    at = np.flatnonzero(total > 0)
    sums = total[at]
    if len(at) > k:
        # Only what may be a tie after rounding is rounded.
        close = sums >= np.partition(sums, len(at) - k)[len(at) - k] - 2 / UNIT
        at, sums = at[close], sums[close]
    units = np.floor(sums * UNIT + 0.5)
    at, units = at[units > 0], units[units > 0]
    own = _first(units, k)
    return at[own], units[own]


class _Vectors:
    """The vectors of a place.  They are whole numbers, so their products are exact in few digits as far as these go."""

    def __init__(self, place: _Place, rows: list[tuple[np.ndarray, np.ndarray]], longest: float) -> None:
        ids = np.concatenate([ids for ids, _ in rows])
        order = np.argsort(ids)
        m = np.concatenate([v for _, v in rows])[order]
        rows.clear()
        norms = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
        kept = norms > 0
        self.ids, self.norms, self.place = ids[order][kept], norms[kept], place
        self.m = m[kept].astype(np.float32 if longest * norms.max(initial=0) < 2**24 else np.float64)
        self.shares = (1 / self.norms).astype(self.m.dtype)
        self.at = np.searchsorted(place.ids, self.ids)

    def products(self, queries: np.ndarray) -> np.ndarray:
        return queries.astype(self.m.dtype) @ self.m.T

    def best(self, dots: np.ndarray, norm: float, k: int, wanted: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of one query and their cosines in units, as exact as the products."""
        near = dots * self.shares
        at = None
        for column, values in wanted:
            if values:
                mask = self.place.allowed(column, values)[self.at]
                at = np.flatnonzero(mask) if at is None else at[mask[at]]
        if at is not None:
            near = near[at]
        if len(near) > k:
            # Further down than rounding and few digits can bring any of the best.
            close = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 3e-6 * norm)
            at = close if at is None else at[close]
        elif at is None:
            at = np.arange(len(near))
        exact = dots[at].astype(np.float64) / (norm * self.norms[at]) * UNIT
        units = np.copysign(np.floor(np.abs(exact) + 0.5), exact)
        own = _first(units, k)
        return self.ids[at[own]], units[own]


BOTH = "query_id bigint, pool bigint, sums binary, near binary"
NONE = np.zeros(0, dtype=np.int64)


def _packed_hits(ids: np.ndarray, units: np.ndarray) -> bytes:
    """Hits in the order of their ids, as differences and byte by byte, of which most are zero: so they shuffle in half the room."""
    order = np.argsort(ids)
    rows = np.stack([np.diff(ids[order], prepend=0), units[order].astype(np.int64)]).astype("<i8")
    return np.ascontiguousarray(rows.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes()


def _unpacked_hits(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(2, 8, len(packed) // 16).transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return np.cumsum(rows[0]), rows[1]


def _best_of_both(dimensions: int):
    """``BOTH``: ``_best`` with the rows of the best cosines beside those of the best sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[np.ndarray, np.ndarray]] = []
        asked: dict[int, tuple] = {}
        norms: list[float] = []

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("kind").to_numpy()
                for k in (0, 1):
                    if (kinds == k).any():
                        own = batch.filter(pa.array(kinds == k))
                        if k:
                            known.append((own.column("id").to_numpy(), unpacked_vectors(own.column("v"), dimensions)))
                        else:
                            v = own.column("asked").flatten().to_numpy().reshape(own.num_rows, dimensions)
                            norms.append(np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)).max())
                            asked.update((q, (v[i], *rest)) for i, (q, *rest) in enumerate(zip(*(own.column(c).to_pylist() for c in ("id", "n", "languages", "paths")))))
                yield batch.drop_columns(["v", "asked"])

        vectors, places = None, []

        def together(some: list[int], sums: dict[int, tuple]) -> pa.RecordBatch:
            matrix = np.stack([asked[q][0] for q in some])
            found = []
            for q, v, dots in zip(some, matrix.astype(np.float64), vectors.products(matrix)):
                _, pool, languages, paths = asked.pop(q)
                norm = math.sqrt(v @ v)
                near = vectors.best(dots, norm, pool, (("language", languages), ("path", paths))) if norm else (NONE, NONE)
                found.append((q, pool, _packed_hits(*sums.get(q, (NONE, NONE))), _packed_hits(*near)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["query_id", "pool", "sums", "near"])

        for given in _best(kept(), places):
            vectors = vectors or _Vectors(places[0], known, max(norms))
            sums = {q.as_py(): (ids.values.to_numpy(), units.values.to_numpy()) for q, ids, units in zip(*(given.column(c) for c in ("query_id", "ids", "units")))}
            yield together(list(sums), sums)
        if places and asked:
            vectors = vectors or _Vectors(places[0], known, max(norms))
            rest = list(asked)
            for a in range(0, len(rest), GIVEN):
                yield together(rest[a : a + GIVEN], {})

    return run


def _merged(parts: list[bytes], pool: int) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of one query from those of the places, ties to the smaller id."""
    ids, units = (np.concatenate(x) for x in zip(*map(_unpacked_hits, parts)))
    order = np.lexsort((ids, -units))[:pool]
    return ids[order], units[order]


def _both_of_places(best: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, bm25_score, bm25_rank, dense_score, dense_rank)``: the best of all places, one row per query and
    chunk, null where a retriever does not name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, pool, *hits in zip(*(batch.column(c).to_pylist() for c in ("query_id", "pool", "sums", "near"))):
                sums, near = (_merged(parts, pool) for parts in hits)
                ids = np.union1d(sums[0], near[0])
                out = []
                for own, scores in (sums, near):
                    at = np.searchsorted(ids, own)
                    score, rank, no = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int32), np.ones(len(ids), dtype=bool)
                    score[at], rank[at], no[at] = scores / UNIT, np.arange(1, len(own) + 1), False
                    out += [pa.array(score, mask=no), pa.array(rank, mask=no)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), *out], names=["query_id", "chunk_id", "bm25_score", "bm25_rank", "dense_score", "dense_rank"])

    gathered = best.groupBy("query_id").agg(F.max("pool").alias("pool"), *(F.collect_list(c).alias(c) for c in ("sums", "near")))
    return gathered.mapInArrow(run, "query_id bigint, chunk_id bigint, bm25_score double, bm25_rank int, dense_score double, dense_rank int")


def _codes(run: Run) -> DataFrame:
    return cut(run.stage("query_terms").select("term").distinct().selectExpr("term", "cast(row_number() over (order by term) as int) as code"))


def _bags_of(run: Run, codes: DataFrame, dimensions: int, names: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings of the batch's terms, where no index is kept, and the terms' frequencies."""
    packed = stored(chunk_bags(run, {r.term: r.code for r in codes.toLocalIterator()}, dimensions, names))
    n = run.stage("chunk_rows").count()
    run.offer("corpus_stats", cut(packed.selectExpr(f"{n}L as n_chunks", f"case when {n} > 0 then coalesce(cast(sum(n) as double), 0) / {n} else 0.0D end as avg_doc_len")))
    return packed, packed.select("codes").mapInArrow(_frequencies, "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df"))


def _weighted(run: Run, codes: DataFrame, frequency: DataFrame) -> DataFrame:
    """The queries with their terms' weights."""
    stats = run.stage("corpus_stats").selectExpr("n_chunks", "cast(avg_doc_len as double) as mean")
    idf = frequency.crossJoin(F.broadcast(stats)).selectExpr("code", "ln((n_chunks - df + 0.5) / (df + 0.5) + 1) as idf")
    # A query whose terms no chunk holds has dense hits all the same.
    weights = run.stage("query_terms").join(codes, "term").join(idf, "code", "left").selectExpr("query_id", "code", "coalesce(idf, 0.0D) as idf")
    of = weights.groupBy("query_id").agg(F.collect_list(F.struct("code", "idf")).alias("t")).crossJoin(F.broadcast(stats.select("mean")))
    return of.join(run.stage("query_rows").select("query_id", "pool", "filter_languages", "filter_paths"), "query_id")


def _with_vectors(run: Run, queries: DataFrame, dimensions: int) -> DataFrame:
    parts = run.stage("query_vectors").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), F.col("v").cast("int")))).alias("parts"))
    return queries.join(parts, "query_id", "left").withColumn("asked", F.expr(f"transform(sequence(0, {dimensions - 1}), i -> coalesce(parts[i], 0))"))


def _places(run: Run) -> int:
    return max(run.spark.sparkContext.defaultParallelism, math.ceil(run.stage("chunk_rows").count() / PLACE))


def asked_of_places(run: Run, names: dict[str, int]) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """The number of places, the queries that go to them with weights and vectors, the bags of the chunks, which have the
    definitions of ``names`` too, and the codes of the terms."""
    from quern.plans.stages import DIMENSIONS

    codes = _codes(run)
    bags, frequency = _bags_of(run, codes, DIMENSIONS, names)
    return _places(run), _with_vectors(run, _weighted(run, codes, frequency), DIMENSIONS), bags, codes


def bm25_sums(run: Run) -> DataFrame:
    """``bm25_hits``: the chunks that hold a query term and pass the query's filter, ranked as far as the query's pool goes."""
    from quern.plans.stages import DIMENSIONS

    chunks, codes = run.stage("chunk_rows"), _codes(run)
    few = codes.count() <= BROUGHT
    bare = few and "postings_built" not in run.done
    both = bare and run.hybrid and run.encoder is None and not {"dense_hits", "chunk_vectors"} & set(run.done)
    if bare:
        # No index is kept: only the postings of the batch's terms are made.
        packed, frequency = _bags_of(run, codes, DIMENSIONS if both else 0)
    else:
        near = F.broadcast(codes) if few else codes
        asked = run.stage("postings_built").join(near, "term")
        frequency = run.done["term_frequencies"].join(near, "term").select("code", "df") if "term_frequencies" in run.done else asked.groupBy("code").agg(F.count("*").alias("df"))
        packed = asked.selectExpr("chunk_id as id", "doc_len as n", "code", "cast(tf as int) as tf").mapInArrow(_packed, PACKED)
    queries = _weighted(run, codes, frequency)
    if both:
        queries = _with_vectors(run, queries, DIMENSIONS)
    places = _places(run)
    place = F.pmod(F.xxhash64("id"), F.lit(places)).cast("int").alias("place")
    left = queries.selectExpr(
        f"explode(sequence(0, {places - 1})) as place", "0 as kind", "query_id as id", "pool as n", "t.code as codes", "t.idf as idfs", "mean", "filter_languages as languages", "filter_paths as paths", *["asked"] * both,
    )
    packed = packed.select(place, F.lit(1).alias("kind"), "id", "n", "codes", "tfs", *["v"] * both)
    keys = chunks.selectExpr("chunk_id as id", "language", "file_path as path").select(place, F.lit(2).alias("kind"), "id", "language", "path")
    met = left.unionByName(packed, allowMissingColumns=True).unionByName(keys, allowMissingColumns=True)
    met = met.repartitionById(places, F.col("place")).drop("place")
    if both:
        hits = stored(_both_of_places(met.mapInArrow(_best_of_both(DIMENSIONS), BOTH)))
        run.offer("both_hits", hits)
        run.offer("dense_hits", hits.where("dense_rank is not null").selectExpr("query_id", "chunk_id", "dense_score as score", "dense_rank as rank"))
        return hits.where("bm25_rank is not null").selectExpr("query_id", "chunk_id", "bm25_score as score", "bm25_rank as rank")
    best = met.mapInArrow(_best, BEST)
    return best_of_places(best).withColumnRenamed("id", "chunk_id")

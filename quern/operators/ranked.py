"""Hybrid hits of a batch of queries without a row for every candidate.

The places of ``sparse`` know a chunk's file, its classes, and the terms of its path, so they answer with their hits what
a query's boosts and penalties ask of these.  One step per query then fuses, boosts, penalises and ranks its candidates;
only what is asked for leaves it: ``hits``, ``boosted`` candidates, or ``stems`` of files.  The rules are those of the
stages from ``rrf_parts`` to ``hybrid_hits``.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import classify
from quern.functions.dialect import SPARK
from quern.functions.text import stop_list
from quern.operators.cards import card_candidates
from quern.operators.dense import GIVEN
from quern.operators.defined import CODES
from quern.operators.postings import unpacked_vectors
from quern.operators.sparse import UNIT, _Place, _Vectors, asked_of_places, best_sums
from quern.session import cut, stored

if TYPE_CHECKING:
    from quern.plans.runner import Run

#: Classes of a file, a bit each; above them 1 bit for a query that names the file, 3 for shared path terms, the rest for stem matches.
FLAGS = ("is_test", "is_stub", "is_compat", "is_example", "is_type_def", "is_test_lower", "is_test_file_lower", "is_example_lower", "is_public", "api", "docs")
BIT = {f: 1 << i for i, f in enumerate(FLAGS)}
NAMED, SHARED, MATCHES = len(FLAGS), len(FLAGS) + 1, len(FLAGS) + 4
#: Beyond so many shared terms no boost grows.
MOST = 4
#: What is known of a query, in this order.
FACTS = ("alpha", "top_k", "path_intent", "wants_public_api", "wants_test_file", "wants_docs", "wants_examples", "wants_source_file", "allow_tests", "allow_examples", "allow_type_defs", "words", "public")
#: Chunks that share two terms with a query and join its candidates, and candidates that the retrievers do not name.
JOINING, OTHERS = 32, 96

OUT = "query_id bigint, pool bigint, facts array<double>, sums binary, near binary, added binary, other binary"
HITS = "query_id bigint, chunk_id bigint, file bigint, score double, rank int, boosted double, rrf double, bm25_score double, bm25_rank int, dense_score double, dense_rank int"
BOOSTED = "query_id bigint, chunk_id bigint, score double"
STEMS = "query_id bigint, file bigint, share double, public double"


def packed(ids: np.ndarray, *columns: np.ndarray) -> bytes:
    """Whole numbers by rising id, byte by byte, without the bytes that are zero in all rows."""
    if not len(ids):
        return b""
    order = np.argsort(ids, kind="stable")
    rows = np.empty((1 + len(columns), len(ids)), dtype="<i8")
    for row, values in zip(rows, (ids, *columns)):
        row[:] = values[order]
    rows[0, 1:] -= rows[0, :-1].copy()
    planes = rows.view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1)
    used = planes.any(axis=2)
    return len(ids).to_bytes(4, "little") + np.packbits(used, axis=1).tobytes() + planes[used].tobytes()


def unpacked(parts: list[bytes], columns: int) -> np.ndarray:
    out = []
    for b in filter(None, parts):
        n, head = int.from_bytes(b[:4], "little"), 4 + columns
        used = np.unpackbits(np.frombuffer(b[4:head], np.uint8)[:, None], axis=1).astype(bool)
        planes = np.zeros((columns, 8, n), dtype=np.uint8)
        planes[used] = np.frombuffer(b, np.uint8, offset=head).reshape(-1, n)
        rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0].copy()
        rows[0] = np.cumsum(rows[0])
        out.append(rows)
    return np.concatenate(out, axis=1) if out else np.zeros((columns, 0), dtype=np.int64)


class _Files:
    """The files of a place's chunks."""

    def __init__(self, place: _Place) -> None:
        keys = pa.Table.from_batches(place.keys).combine_chunks()
        at = np.searchsorted(place.ids, keys.column("id").to_numpy())
        self.n = len(place.ids)
        self.file, self.bits = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        self.file[at], self.bits[at] = keys.column("file").to_numpy(), keys.column("bits").to_numpy()
        self.terms, self.forms, self.parts = (self._by_value(keys.column(c), at) for c in ("terms", "forms", "parts"))
        self.sorted_parts = sorted(self.parts)
        self.matched: dict[str, np.ndarray] = {}

    @staticmethod
    def _by_value(column: pa.ChunkedArray, at: np.ndarray) -> dict[str, np.ndarray]:
        lists = column.combine_chunks()
        rows = np.repeat(at, np.diff(lists.offsets.to_numpy()))
        values = lists.flatten().dictionary_encode()
        codes = values.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(values.dictionary) + 1))
        rows = rows[order]
        return {v: rows[a:b] for v, a, b in zip(values.dictionary.to_pylist(), ends[:-1], ends[1:])}

    def matches(self, word: str) -> np.ndarray:
        """What the parts of a chunk's stem and directory are worth to a query's word: 1 where one of them is the word or begins
        like it, 1 more by the synonym."""
        if word not in self.matched:
            if len(self.matched) > 200:
                self.matched.clear()
            hit = np.zeros(self.n, dtype=np.int64)
            near = [word[:k] for k in range(3, len(word))] + [word]
            if len(word) >= 3:
                a = bisect_left(self.sorted_parts, word)
                while a < len(self.sorted_parts) and self.sorted_parts[a].startswith(word):
                    near.append(self.sorted_parts[a])
                    a += 1
            for p in near:
                if p in self.parts:
                    hit[self.parts[p]] = 1
            if word in ("implementation", "implementations") and "impls" in self.parts:
                syn = np.zeros(self.n, dtype=np.int64)
                syn[self.parts["impls"]] = 1
                hit = np.where(hit == 1, 1 + syn, 2 * syn)
            self.matched[word] = hit
        return self.matched[word]

    def shared(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many of a query's terms the chunks' paths share, and whether one names the file."""
        shared, named = np.zeros(self.n, dtype=np.int8), np.zeros(self.n, dtype=bool)
        for t in terms[:127]:
            if t in self.terms:
                shared[self.terms[t]] += 1
            if t in self.forms:
                named[self.forms[t]] = True
        for t in terms[127:]:
            if t in self.terms:
                shared[self.terms[t]] = np.minimum(shared[self.terms[t]], MOST) + 1
            if t in self.forms:
                named[self.forms[t]] = True
        return shared, named

    def attributes(self, at: np.ndarray, shared: np.ndarray, named: np.ndarray, words: list[str]) -> np.ndarray:
        """The classes of some chunks with what a query's terms and words find in their paths."""
        if not len(at):
            return at
        out = self.bits[at] | named[at].astype(np.int64) << NAMED | np.minimum(shared[at], MOST).astype(np.int64) << SHARED
        if words:
            out |= sum(self.matches(w)[at] for w in words) << MATCHES
        return out


def _of_places(dimensions: int):
    """``OUT``: per place and query the best sums and products, the first chunks that share two path terms, and the chunks that
    the query gets otherwise, all with their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind: tuple[list, ...] = ([], [], [], [])
        known: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for k, rows in enumerate(by_kind):
                if (kinds == k).any():
                    own = batch.filter(pa.array(kinds == k))
                    if k == 1:
                        known.append((own.column("id").to_numpy(), unpacked_vectors(own.column("v"), dimensions)))
                        own = own.select(["id", "n", "codes", "tfs"])
                    rows.append(own)
        asked, postings, keys, others = by_kind
        if not asked or not postings:
            return
        place = _Place(postings, keys, pa.Table.from_batches(asked))
        files, vectors = _Files(place), None
        extra: dict[int, list] = {}
        for b in others:
            for q, *row in zip(*(b.column(c).to_pylist() for c in ("n", "id", "part", "tier", "placed"))):
                extra.setdefault(q, []).append(row)
        asked_vectors = [b.column("asked").flatten().to_numpy().reshape(b.num_rows, dimensions) for b in asked]
        longest = max(np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)).max() for v in asked_vectors)
        vectors = _Vectors(place, known, longest)
        total, found = np.zeros(len(place.ids)), []
        for batch, matrix in zip(asked, asked_vectors):
            ends, codes = batch.column("codes").offsets.to_numpy(), batch.column("codes").values.to_numpy()
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("id", "n", "languages", "paths", "terms", "words", "facts"))))
            for i, (q, pool, languages, paths, terms, words, facts) in enumerate(rows):
                if i % GIVEN == 0:
                    products = vectors.products(matrix[i : i + GIVEN])
                total[:] = 0
                for c in codes[ends[i] : ends[i + 1]]:
                    place.add(total, int(c))
                wanted = (("language", languages), ("path", paths))
                mask = None
                for column, values in wanted:
                    if values:
                        passed = place.allowed(column, values)
                        mask = passed if mask is None else mask & passed
                if mask is not None:
                    total *= mask
                shared, named = files.shared(terms)
                own = lambda at: files.attributes(at, shared, named, words)
                at, units = best_sums(total, pool)
                sums = packed(place.ids[at], units, place.ids[at] - files.file[at], own(at))
                v = matrix[i].astype(np.float64)
                norm = math.sqrt(v @ v)
                ids, units = vectors.best(products[i % GIVEN], norm, pool, wanted) if norm else (np.zeros(0, dtype=np.int64),) * 2
                at = np.searchsorted(place.ids, ids)
                near = packed(ids, units, ids - files.file[at], own(at))
                at = np.flatnonzero(shared >= 2 if mask is None else (shared >= 2) & mask)[: JOINING + 2 * pool + OTHERS + int(facts[-1])]
                added = packed(place.ids[at], place.ids[at] - files.file[at], own(at))
                other = b""
                if more := extra.pop(q, []):
                    ids = np.array([x[0] for x in more], dtype=np.int64)
                    at = np.searchsorted(place.ids, ids)
                    values = [np.array([np.nan if x[k] is None else x[k] for x in more]).view(np.int64) for k in (1, 2)]
                    placed = np.array([bool(x[3]) for x in more], dtype=bool) & (True if mask is None else mask[at])
                    other = packed(ids, ids - files.file[at], own(at), *values, placed.astype(np.int64))
                if sums or near or added or other:
                    found.append((q, pool, facts, sums, near, added, other))
                if len(found) >= GIVEN:
                    yield _batch(found)
                    found = []
        if found:
            yield _batch(found)

    return run


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["query_id", "pool", "facts", "sums", "near", "added", "other"])


def _round(x: np.ndarray, digits: int) -> np.ndarray:
    unit = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * unit + 0.5), x) / unit


class _Candidates:
    """The candidates of one query, from their fusion on."""

    def __init__(self, pool: int, facts: list[float], sums: list[bytes], near: list[bytes], added: list[bytes], other: list[bytes]) -> None:
        from quern.plans.stages import RRF

        self.facts = f = dict(zip(FACTS, facts))
        self.added = unpacked(added, 3)
        sums, near, other = unpacked(sums, 4), unpacked(near, 4), unpacked(other, 6)
        sums, near = (x[:, np.lexsort((x[0], -x[1]))[:pool]] for x in (sums, near))
        part, tier = other[3].view(np.float64), other[4].view(np.float64)
        parts = ~np.isnan(part)
        self.ids = np.unique(np.concatenate([sums[0], near[0], other[0][parts]]))
        n = len(self.ids)
        self.file, self.attr = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.units, self.ranks = np.zeros((2, n), dtype=np.int64), np.zeros((2, n), dtype=np.int64)
        fused = np.zeros(n)
        for k, (x, weight) in enumerate(((near, f["alpha"]), (sums, 1 - f["alpha"]))):
            at = np.searchsorted(self.ids, x[0])
            self.file[at], self.attr[at] = x[0] - x[2], x[3]
            self.units[k, at], self.ranks[k, at] = x[1], np.arange(1, len(at) + 1)
            fused[at] += weight / (RRF + self.ranks[k, at])
        lower, upper = self.ranks.min(axis=0), self.ranks.max(axis=0)
        at = np.flatnonzero((lower > 0) & (upper <= 50))
        b, balance = RRF + lower[at], 1 / (1 + (upper[at] - lower[at]) / 25.0)
        fused[at] += 0.35 / b * balance + np.where(upper[at] <= 5, 1.5 / b * balance, 0)
        at = np.searchsorted(self.ids, other[0][parts])
        np.add.at(fused, at, part[parts])
        self.file[at], self.attr[at] = other[0][parts] - other[1][parts], other[2][parts]
        self.fused = _round(fused, 9)
        self._coherent()
        self._defined(other[:, ~np.isnan(tier)])

    def _in_files(self, scores: np.ndarray, file: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates by file and falling score, each one's place in its file from 0, and where the files begin."""
        order = np.lexsort((ids, -scores, file))
        starts = np.flatnonzero(np.diff(file[order], prepend=file[order][:1] - 1)) if len(order) else order
        places = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        return order, places, starts

    def _coherent(self) -> None:
        self.score, self.m = self.fused.copy(), 0.0
        if not len(self.ids):
            return
        order, _, starts = self._in_files(self.fused, self.file, self.ids)
        by_file = _round(np.add.reduceat(self.fused[order], starts), 9)
        best, first = max(self.fused.max(), 0), order[starts]
        if best > 0:
            self.score[first] += 0.2 * best * by_file / by_file.max()
        self.score = _round(self.score, 9)
        self.m = self.score.max()

    @property
    def share(self) -> tuple[np.ndarray, np.ndarray]:
        """What the stem and directory of each candidate answer of the query's words, and what a public interface is worth."""
        words = self.facts["words"]
        if not words:
            return np.zeros(len(self.ids)), np.zeros(len(self.ids))
        return (self.attr >> MATCHES) / words, np.where(self.attr & BIT["is_public"] > 0, 0.8 * self.facts["public"], 0.0)

    def _defined(self, other: np.ndarray) -> None:
        """Definitions raise candidates, and others join them where the query points to them."""
        self.stems = (self.file, *self.share)
        tier = np.zeros(len(self.ids))
        at = np.minimum(np.searchsorted(self.ids, other[0]), max(len(self.ids) - 1, 0))
        there = self.ids[at] == other[0] if len(self.ids) else np.zeros(other.shape[1], dtype=bool)
        tiers = other[4].view(np.float64)
        tier[at[there]] = tiers[there]
        self.score = _round(self.score + self.m * (self.stems[1] + self.stems[2]) + self.m * tier, 9)
        joins = ~there & (other[5] > 0)
        if self.m > 0 and joins.any():
            self._join(other[0][joins], other[0][joins] - other[1][joins], other[2][joins], _round(self.m * tiers[joins], 9))

    def _join(self, ids: np.ndarray, file: np.ndarray, attr: np.ndarray, score: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.file, self.attr, self.score = (np.concatenate(x) for x in ((self.ids, ids), (self.file, file), (self.attr, attr), (self.score, score)))
        self.units, self.ranks = (np.concatenate([x, np.zeros((2, n), dtype=np.int64)], axis=1) for x in (self.units, self.ranks))
        self.fused = np.concatenate([self.fused, np.full(n, np.nan)])

    def by_path(self) -> None:
        f = self.facts
        if not f["path_intent"]:
            return
        if self.m > 0 and self.added.shape[1]:
            new = self.added[:, ~np.isin(self.added[0], self.ids)]
            new = new[:, np.argsort(new[0])[:JOINING]]
            self._join(new[0], new[0] - new[1], new[2], _round(self.m * np.minimum(0.25 + 0.2 * (new[2] >> SHARED & 7), 0.9), 9))
        has = lambda *flags: self.attr & sum(BIT[x] for x in flags) > 0
        shared = self.attr >> SHARED & 7
        gain = np.where(shared > 0, np.minimum(0.18 * shared, 0.7), 0.0) + 0.35 * (self.attr >> NAMED & 1)
        for wish, flag, worth in (("wants_public_api", "api", 0.5), ("wants_test_file", "is_test_lower", 0.7), ("wants_docs", "docs", 0.6), ("wants_examples", "is_example_lower", 0.6)):
            if f[wish]:
                gain = gain + np.where(has(flag), worth, 0.0)
        less = np.where(has("is_test_file_lower", "is_example_lower"), 0.8, 1.0) if f["wants_source_file"] else 1.0
        self.score = _round(self.score * less + self.m * gain, 9)

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the best and their scores after penalties, each further one of a file at half its score."""
        f, score = self.facts, self.score
        if f["alpha"] < 1:
            for flag, allowed, factor in (("is_test", "allow_tests", 0.3), ("is_stub", None, 0.5), ("is_compat", None, 0.3), ("is_example", "allow_examples", 0.3), ("is_type_def", "allow_type_defs", 0.7)):
                if not (allowed and f[allowed]):
                    score = score * np.where(self.attr & BIT[flag] > 0, factor, 1.0)
        order, places, _ = self._in_files(score, self.file, self.ids)
        final = _round(score[order] * 0.5 ** np.minimum(places, 1000), 6)
        best = np.lexsort((self.ids[order], -final))[: int(f["top_k"])]
        return order[best], final[best]


def _ranked(kind: str):
    def rows(q: int, c: _Candidates) -> list[pa.Array]:
        many = lambda n: pa.array(np.full(n, q))
        if kind == "stems":
            file, at = np.unique(c.stems[0], return_index=True)
            if not c.facts["words"]:
                file, at = file[:0], at[:0]
            return [many(len(file)), pa.array(file), pa.array(c.stems[1][at]), pa.array(c.stems[2][at])]
        c.by_path()
        if kind == "boosted":
            return [many(len(c.ids)), pa.array(c.ids), pa.array(c.score)]
        at, score = c.hits()
        out = [many(len(at)), pa.array(c.ids[at]), pa.array(c.file[at]), pa.array(score), pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), pa.array(c.score[at]), pa.array(c.fused[at], mask=np.isnan(c.fused[at]))]
        for k in (1, 0):
            no = c.ranks[k, at] == 0
            out += [pa.array(c.units[k, at] / UNIT, mask=no), pa.array(c.ranks[k, at].astype(np.int32), mask=no)]
        return out

    names = [x.split()[0] for x in {"hits": HITS, "boosted": BOOSTED, "stems": STEMS}[kind].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list[pa.Array]] = []
        given = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("query_id", "pool", "facts", "sums", "near", "added", "other"))))
        for q, parts in groupby(given, lambda x: x[0]):
            _, pools, facts, *hits = zip(*parts)
            made.append(rows(q, _Candidates(max(pools), facts[0], *hits)))
            if len(made) >= GIVEN:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*made)], names=names)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*made)], names=names)

    return run


def _definitions(run: Run, bags: DataFrame, names: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, tier, placed)``: chunks that define a name of a query, what that is worth, and whether they join
    the candidates."""
    run.offer("coded_names", names)
    run.offer("found_definitions", cut(bags.where("size(defs) > 0").selectExpr("id as chunk_id", "explode(defs) as d").selectExpr("chunk_id", f"cast(floor(d / {CODES}) as int) as code", f"d % {CODES} as words")))
    p = run.prefix
    low, stem = "lower(n.name)", "f.stem"
    forms = f"array({stem}, replace({stem}, '_', ''), rtrim('s', {stem}), rtrim('s', replace({stem}, '_', '')))"
    begins = lambda form: f"({form} <> '' AND startswith({low}, {form}) AND ({form} = {low} OR length({form}) >= 4))"
    placed = f"((n.main AND array_contains({forms}, {low})) OR (n.unit < 2 AND ({begins(stem)} OR {begins(f"replace({stem}, '_', '')")})))"
    run.stage("file_features"), run.stage("chunk_keys"), run.stage("query_names")
    return run.spark.sql(f"""SELECT d.query_id, d.chunk_id, CAST(max(n.unit) * CASE WHEN max(CASE WHEN array_contains({forms}, {low}) THEN 1 ELSE 0 END) = 1 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS tier, max(d.placed OR {placed}) AS placed FROM (
        SELECT n.query_id, d.chunk_id, max(n.unit > 2 AND CASE WHEN n.main THEN d.words IN (1, 3) ELSE d.words > 0 END) AS placed
        FROM {p}found_definitions d JOIN {p}coded_names c ON d.code = c.code JOIN {p}query_names n ON c.name = n.name GROUP BY n.query_id, d.chunk_id) d
      JOIN {p}query_names n ON d.query_id = n.query_id JOIN {p}chunk_keys k ON d.chunk_id = k.chunk_id JOIN {p}file_features f ON k.file_path = f.file_path GROUP BY d.query_id, d.chunk_id""")


def ranked(run: Run, kind: str) -> DataFrame:
    """``HITS`` with the files' paths, ``BOOSTED``, or ``STEMS`` with paths: for a batch whose index is not kept."""
    from quern.functions.text import query_path_terms
    from quern.plans.stages import DIMENSIONS

    spark = run.spark
    # Read so often from here on that it is written once.
    run._view("chunk_keys", stored(run.stage("chunk_keys")))
    names = cut(run.stage("query_names").select("name").distinct().selectExpr("name", "cast(row_number() over (order by name) as int) as code"))
    places, queries, bags, codes = asked_of_places(run, {r.name: r.code for r in names.toLocalIterator()} if kind != "stems" else {})
    p = run.prefix
    run.stage("file_features")
    run.offer("first_chunks", stored(spark.sql(f"SELECT file_path, min(chunk_id) AS file FROM {p}chunk_keys GROUP BY file_path")))
    others = run.stage("symbol_candidates").select("query_id", "chunk_id", F.col("part").cast("double")).unionByName(card_candidates(run, bags, codes, places))
    others = others.withColumns({"tier": F.lit(None).cast("double"), "placed": F.lit(False)})
    if kind != "stems":
        tiers = cut(_definitions(run, bags, names))
        others = others.unionByName(tiers.withColumn("part", F.lit(None).cast("double")))
        queries = queries.join(tiers.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left")
    else:
        queries = queries.withColumn("more", F.lit(0))
    # What the boosts and penalties ask of the queries and the files.
    public = ", ".join(f"'{w}'" for w in classify.PUBLIC_WORDS)
    words = f"(SELECT t.query_id, collect_set(t.term) AS words FROM {p}query_terms t JOIN {p}query_rows q ON t.query_id = q.query_id WHERE q.stem_boost AND NOT q.is_symbol AND length(t.term) > 2 AND t.term NOT IN {stop_list()} GROUP BY t.query_id)"
    facts = {"words": "coalesce(size(w.words), 0)", "public": f"exists(coalesce(w.words, array()), x -> x IN ({public}))"}
    listed = ", ".join(f"cast({facts.get(f, f'q.{f}')} as double)" for f in FACTS)
    known = spark.sql(f"SELECT q.query_id, {query_path_terms(SPARK, 'q.query_text')} AS terms, coalesce(w.words, cast(array() as array<string>)) AS words, array({listed}) AS facts FROM {p}query_rows q LEFT JOIN {words} w ON q.query_id = w.query_id")
    queries = queries.join(known, "query_id").withColumn("facts", F.expr("concat(facts, array(cast(coalesce(more, 0) as double)))"))
    flags = {f: f for f in FLAGS} | {"api": "array_contains(path_terms, 'api') or array_contains(path_terms, 'public')", "docs": "array_contains(path_terms, 'doc') or array_contains(path_terms, 'docs')"}
    bits = " + ".join(f"case when {x} then {BIT[f]} else 0 end" for f, x in flags.items())
    forms = "array_distinct(flatten(transform(own_parts, x -> array(x, replace(x, '_', ''), rtrim('s', x), rtrim('s', replace(x, '_', ''))))))"
    files = run.stage("file_features").selectExpr("file_path", f"cast({bits} as bigint) as bits", "path_terms as terms", f"{forms} as forms", "stem_parts as parts").join(run.done["first_chunks"], "file_path")
    keys = run.stage("chunk_keys").select("chunk_id", "file_path", "language").join(files, "file_path").selectExpr("chunk_id as id", "language", "file_path as path", "file", "bits", "terms", "forms", "parts")
    place = F.pmod(F.xxhash64("id"), F.lit(places)).cast("int").alias("place")
    left = queries.selectExpr(f"explode(sequence(0, {places - 1})) as place", "0 as kind", "query_id as id", "pool as n", "t.code as codes", "t.idf as idfs", "mean", "filter_languages as languages", "filter_paths as paths", "asked", "terms", "words", "facts")
    met = left.unionByName(bags.select(place, F.lit(1).alias("kind"), "id", "n", "codes", "tfs", "v"), allowMissingColumns=True)
    met = met.unionByName(keys.select(place, F.lit(2).alias("kind"), *keys.columns), allowMissingColumns=True)
    other = others.selectExpr("chunk_id as id", "query_id as n", "part", "tier", "placed")
    met = met.unionByName(other.select(place, F.lit(3).alias("kind"), *other.columns), allowMissingColumns=True)
    out = met.repartitionById(places, F.col("place")).drop("place").mapInArrow(_of_places(DIMENSIONS), OUT)
    # A place has one row of a query, so nothing is gathered before the rows of all places meet.
    gathered = out.repartition(F.col("query_id")).sortWithinPartitions("query_id")
    made = gathered.mapInArrow(_ranked(kind), {"hits": HITS, "boosted": BOOSTED, "stems": STEMS}[kind])
    if kind == "boosted":
        return made
    return stored(made).join(run.done["first_chunks"], "file")

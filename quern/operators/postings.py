"""Index rows of chunks: postings and hashed vectors, a batch of chunks at a time.

Identifiers repeat all over a corpus, so what an identifier gives, its tokens and their hashes, is found once per worker and
looked up after that.  A chunk's counts are complete where the chunk is read; no posting is shuffled to be counted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from quern.functions.text import IDENTIFIER
from quern.operators.defined import Definitions
from quern.operators.encoders import _parts, _variants
from quern.operators.vocabulary import BITS, LOW, Lists, Vocabulary, distinct

if TYPE_CHECKING:
    from quern.plans.runner import Run

#: Identifiers that a worker remembers; beyond them it starts afresh, which costs time only.
REMEMBERED = 1_000_000
#: Chunks whose tokens are in memory at once, where they go through arrays.
AT_ONCE = 2_000
POSTINGS = "term string, chunk_id bigint, tf bigint, doc_len bigint"
VECTORS = "chunk_id bigint, i bigint, v bigint"

_words = re.compile(IDENTIFIER).findall


class _Tokens(dict):
    """The numbers of an identifier's tokens, and the tokens by number."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        #: The numbers of what a part of an identifier gives; parts repeat where identifiers do not.
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str | None, set[int]] = {}

    def __missing__(self, word: str) -> frozenset[int]:
        found: set[int] = set()
        for part in _parts(word):
            own = self.parts.get(part)
            if own is None:
                own = tuple([self.numbers.setdefault(t, len(self.numbers)) for t in _variants(part)])
                self.parts[part] = own
            found.update(own)
        self[word] = made = frozenset(found)
        return made

    def of(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set(_words(text)))) if text else set()

    def of_piece(self, text: str | None) -> set[int]:
        """The same of a short text, which may come again."""
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            self.pieces[text] = found = self.of(text)
        return found


def _of_path(path: str) -> tuple[str, list[str]]:
    *folders, name = path.split("/")
    return re.sub(r"^(.+)[.][^.]*$", r"\1", name), [f for f in folders if f not in ("", ".")][-3:]


def _pieces(path: str, symbols: list | None, crumbs: list | None) -> list[str | None]:
    """What a chunk is indexed by beside its content: its symbols' names twice and their kinds, breadcrumbs, the file's stem
    twice and its last three directories."""
    stem, near = _of_path(path)
    return [*(x for s in symbols or () for x in (s["name"], s["name"], s["kind"])), *(crumbs or ()), stem, stem, *near]


def _counts(known: _Tokens, batch: pa.RecordBatch) -> Iterator[dict[int, int]]:
    """Of every chunk its tokens by number, with the number of its pieces that hold them."""
    for path, text, symbols, crumbs in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
        found = dict.fromkeys(known.of(text), 1)
        for piece in _pieces(path, symbols, crumbs):
            for t in known.of_piece(piece):
                found[t] = found.get(t, 0) + 1
        yield found


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Tokens()
    for batch in batches:
        if len(known) > REMEMBERED:
            known = _Tokens()
        codes, counts, sizes, lengths = [], [], [], []
        for found in _counts(known, batch):
            codes.extend(found)
            counts.extend(found.values())
            sizes.append(len(found))
            lengths.append(sum(found.values()))
        sizes = np.array(sizes, dtype=np.int64)
        terms = pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(list(known.numbers), pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [terms, batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(counts, pa.int64()), pa.array(np.repeat(np.array(lengths, dtype=np.int64), sizes))],
            names=["term", "chunk_id", "tf", "doc_len"],
        )


def _lists(rows: np.ndarray, values: np.ndarray, count: int) -> pa.ListArray:
    """A list for each of ``count`` rows, of values that stand by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


class _Chunks:
    """The bags of some chunks, from what a vocabulary has of their texts and pieces."""

    def __init__(self, known: Vocabulary, batch: pa.RecordBatch) -> None:
        self.known, self.n = known, batch.num_rows
        paths, self.texts, symbols, crumbs, languages = batch.columns[1:6]
        coded = paths.dictionary_encode()
        self.paths, of_path, own = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.arange(self.n)
        places = [_of_path(p) for p in self.paths]
        sizes = np.array([2 + len(near) for _, near in places], dtype=np.int64)
        folders = Lists()
        folders.add(sizes, known.pieces.of([x for stem, near in places for x in (stem, stem, *near)], sizes.sum()))
        sizes, folders = folders.of(of_path)
        self.path_of = of_path
        rows = lambda column: np.repeat(own, pa.compute.list_value_length(column).fill_null(0).to_numpy())
        names, kinds = (known.numbered(pa.compute.struct_field(symbols.flatten(), k)) for k in ("name", "kind"))
        names, kinds = (rows(symbols), names), (rows(symbols), kinds)
        crumbs, path = (rows(crumbs), known.numbered(crumbs.flatten())), (own, known.numbered(paths))
        head, named = known.pieces["path language symbols context"], known.numbered(languages.fill_null("unknown"))
        language = (own, known.numbered(languages))
        known.learn_pieces()
        self.words, self.tokens = known.distinct_of(self.texts.to_pylist())
        self.indexed = self._of(names, names, kinds, crumbs, (np.repeat(own, sizes), folders))
        self.embedded = (path, (own, named), (own, np.full(self.n, head)), names, crumbs)
        self.path, self.card = (path,), (language, names, kinds, crumbs)

    def _of(self, *pieces: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The tokens of chunks' pieces, with the chunks' places."""
        rows, numbers = (np.concatenate(x) for x in zip(*pieces))
        sizes, tokens = self.known.of_piece.of(numbers)
        return np.repeat(rows, sizes) << BITS | tokens

    def _coded(self, keys: np.ndarray) -> np.ndarray:
        codes = self.known.code[keys & LOW]
        kept = codes >= 0
        return keys[kept] >> BITS << BITS | codes[kept]

    def lengths(self) -> np.ndarray:
        return sum(np.bincount(keys >> BITS, minlength=self.n) for keys in (self.tokens, self.indexed))

    def postings(self) -> list[pa.Array]:
        """Codes and counts of the tokens asked for."""
        keys, counts = np.unique(np.concatenate([self._coded(self.tokens), self._coded(self.indexed)]), return_counts=True)
        return [_lists(keys >> BITS, x, self.n) for x in (keys & LOW, counts)]

    def vectors(self) -> pa.Array:
        keys, dimensions = distinct(np.concatenate([self.tokens, self._of(*self.embedded)])), self.known.dimensions
        tokens = keys & LOW
        sums = np.bincount((keys >> BITS) * dimensions + self.known.place[tokens], weights=self.known.sign[tokens], minlength=self.n * dimensions)
        return packed_vectors(sums.reshape(self.n, dimensions))

    def cards(self) -> pa.Array:
        path, others = (distinct(self._coded(self._of(*pieces))) for pieces in (self.path, self.card))
        others = others[~np.isin(others, path)]
        keys = np.sort(np.concatenate([(x >> BITS << BITS) + 2 * (x & LOW) + k for k, x in enumerate((others, path))]))
        return _lists(keys >> BITS, keys & LOW, self.n)

    def definitions(self, defined: Definitions) -> pa.Array:
        met: dict[int, list[str]] = {}
        for key in self.words[self.known.is_watched[self.words & LOW]].tolist():
            met.setdefault(key >> BITS, []).append(self.known.met[key & LOW])
        return defined.of(met, [self.paths[i] for i in self.path_of], self.texts)


def _bags(asked: dict[str, int], dimensions: int, names: dict[str, int] | None = None):
    """``BAGS``: of every chunk its length, its postings of the terms asked for by their codes, its hashed vector where
    ``dimensions`` is not 0, and with ``names`` which of them it defines and what it tells of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        defined = Definitions(names or {})
        fresh = lambda: Vocabulary(asked, dimensions, defined.watched)
        known = fresh()
        for whole in batches:
            for a in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(a, AT_ONCE)
                if len(known) > REMEMBERED:
                    known = fresh()
                chunks, none = _Chunks(known, batch), pa.nulls(batch.num_rows, pa.list_(pa.int32()))
                vectors = chunks.vectors() if dimensions else pa.nulls(batch.num_rows, pa.binary())
                columns = [batch.column(0), pa.array(chunks.lengths(), pa.int64()), *chunks.postings(), vectors, chunks.definitions(defined), none if names is None else chunks.cards()]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "codes", "tfs", "v", "defs", "card"])

    return run


def packed_vectors(m: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, one to a component, or four in rows with a component of more than seven bits."""
    short = (np.abs(m) <= 127).all(axis=1)
    return pa.array([r.astype(np.int8 if s else "<i4").tobytes() for r, s in zip(m, short)], pa.binary())


def unpacked_vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.int8 if len(b) == dimensions else "<i4").astype(np.int32) for b in column.to_pylist()])


class _Hashes:
    """Place and sign of the tokens by number."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions, self.place, self.sign = dimensions, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def sums(self, known: _Tokens, rows: list[set[int]]) -> np.ndarray:
        """The hashed vectors of some sets of tokens, one after the other."""
        digests = [hashlib.md5(t.encode()).hexdigest() for t in list(known.numbers)[len(self.place) :]]
        self.place = np.concatenate([self.place, np.array([int(h[:8], 16) % self.dimensions for h in digests], dtype=np.int64)])
        self.sign = np.concatenate([self.sign, np.array([1 if h[8] < "8" else -1 for h in digests], dtype=np.int64)])
        which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate([np.fromiter(r, dtype=np.int64, count=len(r)) for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        return np.bincount(which * self.dimensions + self.place[flat], weights=self.sign[flat], minlength=len(rows) * self.dimensions)


def _sums(dimensions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The hashed vectors of a batch of texts, one after the other, with the ids."""
    known, hashes = _Tokens(), _Hashes(dimensions)
    for batch in batches:
        if len(known) > REMEMBERED:
            known, hashes = _Tokens(), _Hashes(dimensions)
        yield batch.column(0), hashes.sums(known, [known.of(t) for t in batch.column(1).to_pylist()])


def _vectors(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums in _sums(dimensions, batches):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at // dimensions)), pa.array(at % dimensions), pa.array(sums[at].astype(np.int64))], names=["chunk_id", "i", "v"])

    return run


def _unit_vectors(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums in _sums(dimensions, batches):
            v = sums.reshape(-1, dimensions)
            norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
            kept = np.flatnonzero(norms[:, 0] > 0)
            v = v[kept] / norms[kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dimensions, dtype=np.int32), v.ravel())], names=["chunk_id", "v"])

    return run


INDEXED = ("chunk_id", "file_path", "content", "symbols", "breadcrumbs")


def chunk_postings(run: Run) -> DataFrame:
    """``postings_built``: ``(term, chunk_id, tf, doc_len)``."""
    return run.stage("chunk_rows").select(*INDEXED).mapInArrow(_postings, POSTINGS)


BAGS = "id bigint, n bigint, codes array<int>, tfs array<int>, v binary, defs array<int>, card array<int>"


def chunk_bags(run: Run, asked: dict[str, int], dimensions: int = 0, names: dict[str, int] | None = None) -> DataFrame:
    """``BAGS``: the postings of the terms asked for by chunk, without those of all others being made, and on demand the
    vectors from the same tokens; with ``names`` also the definitions of these, and the terms that the chunk's file is known by,
    as twice their codes and 1 more for those of its path."""
    return run.stage("chunk_rows").select(*INDEXED, "language").mapInArrow(_bags(asked, dimensions, names), BAGS)


def _semantic_texts(run: Run) -> DataFrame:
    from quern.functions.dialect import SPARK
    from quern.functions.text import semantic_text

    return run.sql(f"SELECT chunk_id, {semantic_text(SPARK)} AS s FROM chunk_rows")


def hashed_chunks(run: Run) -> DataFrame:
    """``chunk_vectors``: ``(chunk_id, i, v)``, without the components that are zero."""
    from quern.plans.stages import DIMENSIONS

    return _semantic_texts(run).mapInArrow(_vectors(DIMENSIONS), VECTORS)


def unit_chunks(run: Run) -> DataFrame:
    """``(chunk_id, v)``: the same vectors at length 1, without their components being written; those that are zero are left out."""
    from quern.plans.stages import DIMENSIONS

    return _semantic_texts(run).mapInArrow(_unit_vectors(DIMENSIONS), "chunk_id bigint, v array<double>")

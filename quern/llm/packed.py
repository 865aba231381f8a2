"""Postings packed into blocks before they are shuffled, and per-term totals from the blocks.

Repeated rows of a term and a chunk must meet to count once, so all postings go through one shuffle.  As rows they take
several times the room of their file.  Each task therefore collects its rows, merges repeats and writes one block per
bucket: the distinct terms once, and for every posting the number of its term, of its chunk and its tf in as few bytes as
the block needs.  A bucket is a hash of the chunk and of the term modulo ``SALTS``, so neither a term nor a chunk that
holds a third of all rows ends in one place.  A bucket's blocks are merged in arrays and give one row per term.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the terms of one chunk are spread over.
SALTS = 16
#: Rows that a task collects for its blocks; positions within them fit in 20 bits.
HELD = 1 << 20
#: Rows of one bucket, about: what a worker merges at once.
BUCKET_ROWS = 1_000_000

_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _narrow(values: np.ndarray) -> bytes:
    """An integer array as its least value and the distances to it, in the narrowest width that holds them."""
    low = int(values.min()) if len(values) else 0
    away = (values.astype(np.int64) - low).view(np.uint64)
    top = int(away.max()) if len(values) else 0
    width = next(i for i, w in enumerate(_WIDTHS) if top <= np.iinfo(w).max)
    return struct.pack("<BIq", width, len(values), low) + away.astype(_WIDTHS[width]).tobytes()


def _widen(data: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n, low = struct.unpack_from("<BIq", data, at)
    at += 13
    kind = np.dtype(_WIDTHS[width])
    return np.frombuffer(data, kind, n, at).astype(np.int64) + low, at + n * kind.itemsize


def encode_block(terms: list[bytes], codes: np.ndarray, chunks: np.ndarray, tf: np.ndarray) -> bytes:
    """Postings in the order of their chunks: ``terms[codes[i]]`` stands ``tf[i]`` times in ``chunks[i]``."""
    first = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]])) if len(chunks) else np.zeros(0, dtype=np.int64)
    ids = chunks[first]
    parts = (ids[:1], np.diff(ids), np.diff([*first, len(chunks)]), np.array([len(t) for t in terms], dtype=np.int64), codes, tf)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*map(_narrow, parts), *terms]))


def decode_block(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``(terms, codes, chunks, tf)`` of a block."""
    data, at, parts = zstandard.ZstdDecompressor().decompress(block), 0, []
    for _ in range(6):
        part, at = _widen(data, at)
        parts.append(part)
    start, steps, counts, sizes, codes, tf = parts
    ids = np.cumsum(np.concatenate([start, steps]))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at:]))
    return terms, codes, np.repeat(ids, counts), tf


def _merged(order_key: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct key in its order, and the largest tf of the key."""
    order = np.argsort(order_key)
    key = order_key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order[first], np.maximum.reduceat(tf[order], first)


def _blocks(buckets: int):
    mix, salt_of = np.uint64(0x9E3779B97F4A7C15), lambda t: xxhash.xxh64_intdigest(t) % SALTS

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        coded = table.column(0).combine_chunks().dictionary_encode()
        # Terms are cleaned once per distinct one; those that become equal share a number, empty ones have -1.
        numbers: dict[str, int] = {}
        cleaned = np.array([numbers.setdefault(w, len(numbers)) if w else -1 for w in (t.strip(" ").lower() for t in coded.dictionary.to_pylist())], dtype=np.int64)
        codes, words = cleaned[coded.indices.to_numpy()], [w.encode("utf-8", "surrogatepass") for w in numbers]
        kept = codes >= 0
        codes, chunk, tf = codes[kept], table.column(1).to_numpy()[kept], table.column(2).to_numpy()[kept]
        if not len(codes):
            return
        salts = np.array([salt_of(w) for w in words], dtype=np.uint64)
        ids, chunk = np.unique(chunk, return_inverse=True)
        mixed = (ids.view(np.uint64)[chunk] * np.uint64(SALTS) + salts[codes]) * mix
        bucket = ((mixed ^ (mixed >> np.uint64(32))) * mix >> np.uint64(33)).astype(np.int64) % buckets
        place, tf = _merged(bucket << 40 | chunk << 20 | codes, tf)
        bucket, chunk, codes = bucket[place], ids[chunk[place]], codes[place]
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        made = []
        for a, b in zip(edges, edges[1:]):
            used, local = np.unique(codes[a:b], return_inverse=True)
            made.append(encode_block([words[i] for i in used], local, chunk[a:b], tf[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(made, pa.binary())], names=["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.slice(at, HELD)
                if rows + part.num_rows > HELD:
                    yield from flush(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from flush(held)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def merge(held: list) -> list:
        """One part with one row per posting; the terms of all parts under common numbers."""
        terms = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(c.astype(np.int32)), t) for t, c, _, _ in held]).unify_dictionaries()
        codes = np.concatenate([c.indices.to_numpy() for c in terms.chunks]).astype(np.int64)
        ids, chunk = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
        words = terms.chunk(0).dictionary
        place, tf = _merged(chunk * len(words) + codes, np.concatenate([x[3] for x in held]))
        return [(words, codes[place], ids[chunk[place]], tf)]

    least = 2 * BUCKET_ROWS
    for batch in batches:
        for block in batch.column(1).to_pylist():
            held.append(decode_block(block))
            rows += len(held[-1][1])
            if rows > least:
                # Repeats go; what is left are distinct postings, so the next merge waits for as many again.
                held = merge(held)
                rows = len(held[0][1])
                least = max(least, 2 * rows)
    if held:
        [(words, codes, _, tf)] = merge(held)
        count, total = np.bincount(codes, minlength=len(words)), np.zeros(len(words), dtype=np.int64)
        np.add.at(total, codes, tf)
        yield pa.RecordBatch.from_arrays([words, pa.array(total), pa.array(count.astype(np.int64))], names=["term", "occurrences", "records"])


def bucket_count(df: DataFrame, rows: int | None) -> int:
    """Buckets for so many rows: at least the session's number of shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-(rows or 0) // BUCKET_ROWS))


def term_totals(postings: DataFrame, rows: int | None = None) -> DataFrame:
    """``(term, occurrences, records)`` of the terms, trimmed and in lower case.

    Rows without a term or a chunk are left out; a null tf means that the chunk holds the term an unknown number of times
    and counts as one.  Repeated rows of a term and a chunk count once, with their largest tf.  ``rows`` is about the
    number of rows, for the number of buckets; a wrong one costs time only.  No rows give no rows.
    """
    n = bucket_count(postings, rows)
    plain = postings.where("term is not null and chunk_id is not null").select("term", F.col("chunk_id").cast("bigint"), F.coalesce("tf", F.lit(1)).cast("bigint"))
    blocks = plain.mapInArrow(_blocks(n), "bucket int, block binary")
    parts = blocks.repartitionById(n, F.col("bucket")).mapInArrow(_totals, "term string, occurrences bigint, records bigint")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

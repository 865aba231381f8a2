"""Problem 5: the most similar vectors of every vector, by a forest of sorted hash strings.

A tree gives every vector a string of 64 sign bits of random projections; its array is sorted by them, and vectors that
share a prefix are a node.  ``forest_shape`` sets the shortest prefix, with about ``NODE`` vectors in a node, and as many
trees as a pair at the least similarity needs to share such a node with the target probability, so the forest grows with
the collection; where a node is much fuller its prefix is longer.  Within a node all vectors meet and are screened by the
number of bits that differ; where so many pass that the bits cannot tell the nearest, the node's vectors themselves are
compared in blocks.  What has met carries the longest prefix that it shares in any tree.  From there all trees are
ascended together: first the pairs with long common prefixes are compared, then those with shorter ones, and a vector
stops as soon as its k nearest are so similar that longer prefixes would have found any better ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tables import bucket_number, bucketed, stored

DIMENSIONS = 64
#: The probability with which a pair at the least similarity must share a node of some tree.
RECALL = 0.995
#: Vectors of one node, about; a node that is much fuller (``FULL``) is divided by further bits of its strings.
NODE = 4096
FULL = 16_384
#: Vectors that are drawn to find such nodes before anything is shuffled.
SAMPLE = 20_000
#: Bits by which a common prefix is shortened from one ascent to the next, and the number of ascents before the last.
ASCENT, ASCENTS = 6, 1
#: A vector that more than so many others of its node may be similar to is compared with them exactly.
KEEP = 24
#: Rows of crowded vectors that are still sent to all workers.
BROADCAST = 100_000
#: Standard deviations above the expected number of differing bits that still pass the screen.
SLACK = 2.2
SEED = 11


def usable(vectors: DataFrame, key: str = "chunk_id", column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, v)``: one unit vector per key.  Rows without a key and vectors that are null, of another length, all zero or not finite take no part.

    Of several vectors of one key the smallest holds, whatever the order of rows.
    """
    v = F.col(column)
    kept = vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dimensions)).select(F.col(key), v)
    made = kept.mapInArrow(_unit_rows(key, dimensions), f"`{key}` {vectors.schema[key].dataType.simpleString()}, v array<float>")
    return made.repartition(bucket_number(made), key).groupBy(key).agg(F.min("v").alias("v"))


def _unit_rows(key: str, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Null numbers come as NaN.
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dimensions)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[good]
            units = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, units.size + 1, dimensions, dtype=np.int32), units.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), lists], names=[key, "v"])

    return run


def planes(dimensions: int, trees: int, seed: int = SEED) -> np.ndarray:
    """Projections for ``trees`` strings of 64 bits and one further sketch of 64 bits.

    The planes pass through the origin, so two vectors agree in a bit with a probability that only their angle decides,
    however the collection is spread.
    """
    return np.random.default_rng(seed).standard_normal((dimensions, (trees + 1) * 64)).astype(np.float32)


def _bits(x: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit string per vector and tree; the first bit is the highest."""
    signs = np.packbits((x @ projections) > 0, axis=1)
    return signs.reshape(len(x), -1, 8).view(">u8")[:, :, 0].astype(np.uint64)


def full_nodes(sample: np.ndarray, n: int, projections: np.ndarray, bits: int, trees: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every tree the nodes that hold more than ``FULL`` of ``n`` vectors, and the bits to divide them by, from a sample."""
    strings, found = _bits(sample, projections), []
    for t in range(trees):
        prefix, times = np.unique(strings[:, t] >> np.uint64(64 - bits) if bits else np.zeros(len(sample), dtype=np.uint64), return_counts=True)
        size = times * (n / max(len(sample), 1))
        full = (size > FULL) & (times > 1)
        found.append((prefix[full], np.ceil(np.log2(size[full] / NODE)).astype(np.uint64)))
    return found


def _tree_rows(projections: np.ndarray, bits: int, trees: int, full: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            bits_of = _bits(flat.reshape(n, -1), projections)
            # A node is its tree and its prefix below a leading one, so that prefixes of all lengths are different numbers.
            length = np.full((n, trees), bits, dtype=np.uint64)
            for t, (prefix, more) in enumerate(full):
                if len(prefix):
                    own = bits_of[:, t] >> np.uint64(64 - bits) if bits else np.zeros(n, dtype=np.uint64)
                    at = np.minimum(np.searchsorted(prefix, own), len(prefix) - 1)
                    length[:, t] += np.where(prefix[at] == own, more[at], np.uint64(0))
            node = np.where(length > 0, bits_of[:, :trees] >> (np.uint64(64) - np.maximum(length, 1)), 0) | np.uint64(1) << length | np.arange(trees, dtype=np.uint64) << np.uint64(48)
            # The order of unsigned strings is that of signed numbers once the highest bit is turned.
            strings = np.ascontiguousarray(bits_of ^ np.uint64(1 << 63)).view(np.int64)
            every = np.repeat(np.arange(n), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64).ravel()), pa.array(strings[:, :trees].ravel()), batch.column(0).take(pa.array(every)), pa.array(strings[every, trees])],
                names=["node", "string", "id", "sketch"],
            )

    return run


def forest_shape(n: int, min_similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, trees)``: the length of a node's prefix for ``n`` vectors, and the trees that this length needs."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / NODE)))
    if not bits:
        return 0, 1
    shared = (1 - math.acos(max(-1.0, min(1.0, min_similarity))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-shared))) if shared < 1 else 1


def _nodes(batches: Iterator[pa.RecordBatch], starts) -> Iterator[list[np.ndarray | pa.Array]]:
    """The columns of one node after the other, from sorted batches; ``starts`` says where a new node begins in a table."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        edges = [0, *starts(table).tolist()]
        for begin, end in zip(edges, edges[1:]):
            yield table.slice(begin, end - begin)
        held = table.slice(edges[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts(string: np.ndarray, begin: int, end: int, full: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted strings of at most ``full`` where they differ, by the longest prefixes that this needs."""
    differ = int(string[begin] ^ string[end - 1])
    if end - begin <= full or not differ:
        yield begin, end
        return
    bit = np.uint64(1 << (differ.bit_length() - 1))
    middle = begin + int(np.searchsorted((string[begin:end] & bit) > 0, True))
    yield from _parts(string, begin, middle, full)
    yield from _parts(string, middle, end, full)


def _close(string: np.ndarray, sketch: np.ndarray, most_bits: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ``(i, j)``, i before j, that differ in at most ``most_bits`` bits, in blocks."""
    n = len(string)
    step = max(1, 200_000 // n)
    for begin in range(0, n, step):
        end = min(n, begin + step)
        away = np.bitwise_count(string[begin:end, None] ^ string[None, begin:])
        away += np.bitwise_count(sketch[begin:end, None] ^ sketch[None, begin:])
        i, j = np.divmod(np.flatnonzero(away <= most_bits), n - begin)
        later = j > i
        yield i[later] + begin, j[later] + begin


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of the common prefix of strings."""
    differ = x ^ y
    for step in (1, 2, 4, 8, 16, 32):
        differ = differ | differ >> np.uint64(step)
    return (64 - np.bitwise_count(differ)).astype(np.int32)


def _meet(keep: int, most_bits: float, full: int = FULL, held: int = 2_000_000):
    """``(a, b, length, node)`` from rows sorted by node and string: pairs that pass the screen with the length of
    their common prefix, and, with a null b, the crowded vectors of a node, each of which more than ``keep`` others may be
    similar to.  Pairs of two crowded ones are left out."""

    def starts(table):
        node = table.column(0).to_numpy()
        return np.flatnonzero(node[1:] != node[:-1]) + 1

    def part(node, string, sketch, ids):
        # Rows with the same bits are one code, so that copies cost no more than one vector.
        first = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (sketch[1:] != sketch[:-1])]))
        times, codes, others = np.diff([*first, len(ids)]), string[first], sketch[first]
        counts, found, stored = (times - 1).astype(np.float64), [], 0
        for i, j in _close(codes, others, most_bits):
            counts += np.bincount(i, times[j], len(codes)) + np.bincount(j, times[i], len(codes))
            stored += len(i)
            found = [*found, (i, j)] if stored <= held and len(i) else found
        crowded = counts > keep
        for i, j in found if stored <= held else _close(codes, others, most_bits):
            open_ = ~(crowded[i] & crowded[j])
            i, j = i[open_], j[open_]
            one = (times[i] == 1) & (times[j] == 1)
            length = _common(codes[i], codes[j])
            yield ids[first[i[one]]], ids[first[j[one]]], length[one]
            for x, y, n in zip(i[~one], j[~one], length[~one]):
                yield np.repeat(ids[first[x] : first[x] + times[x]], times[y]), np.tile(ids[first[y] : first[y] + times[y]], times[x]), np.full(times[x] * times[y], n)
        for x in np.flatnonzero((times > 1) & ~crowded):
            i, j = np.triu_indices(times[x], 1)
            yield ids[first[x] + i], ids[first[x] + j], np.full(len(i), 64, dtype=np.int32)
        yield ids[np.repeat(crowded, times)], xxhash.xxh64_intdigest(np.array([node, string[0]], dtype=np.uint64).tobytes()) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches, starts):
            node, string, ids, sketch = (table.column(i).to_numpy() for i in range(4))
            string, sketch = string.view(np.uint64), sketch.view(np.uint64)
            order = np.lexsort((sketch, string))
            string, ids, sketch = string[order], ids[order], sketch[order]
            for begin, end in _parts(string, 0, len(ids), full):
                *pairs, (crowd, part_id) = part(node[0], string[begin:end], sketch[begin:end], ids[begin:end])
                for a, b, length in pairs:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(length, pa.int32()), pa.nulls(len(a), pa.int64())], names=["a", "b", "length", "node"])
                if len(crowd) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.nulls(len(crowd), pa.int64()), pa.nulls(len(crowd), pa.int32()), pa.array(np.full(len(crowd), part_id))], names=["a", "b", "length", "node"])

    return run


def _exact(k: int, min_similarity: float):
    """``(a, b, length)``: of the vectors of every node each one's ``k`` nearest, by block products, ties to the smaller key.

    They are exact within the node, so their prefix counts as a whole string."""

    def starts(table):
        node = table.column(0).to_numpy()
        return np.flatnonzero(node[1:] != node[:-1]) + 1

    def pairs_of(ids, v):
        _, same = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort((ids, same.ravel()))
        same = same.ravel()[order]
        first = np.searchsorted(same, same)
        place = np.arange(len(ids)) - first
        # Of equal vectors the first k + 1 are enough for anyone; the others' nearest are the first k.
        rest = np.flatnonzero(place > k)
        for o in range(k):
            yield ids[order[rest]], ids[order[first[rest] + o]]
        kept = np.sort(order[place <= k])
        kept = kept[np.argsort(ids[kept])]
        ids, v = ids[kept], v[kept].astype(np.float64)
        n, step = len(ids), max(1, 4_000_000 // len(ids))
        for begin in range(0, n, step):
            scores = np.round(v[begin : begin + step] @ v.T, 7)
            low = scores < min_similarity - 1e-6
            scores -= np.arange(n) * 1e-14
            scores[low] = -2
            i = np.arange(len(scores))
            scores[i, i + begin] = -2
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(scores), 1))
            i, j = np.nonzero(np.take_along_axis(scores, best, axis=1) > -2)
            yield ids[begin + i], ids[best[i, j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches, starts):
            ids = table.column(1).to_numpy()
            v = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for a, b in pairs_of(ids, v):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), 64, dtype=np.int32))], names=["a", "b", "length"])

    return run


def candidate_pairs(units: DataFrame, bits: int, trees: int, n: int, min_similarity: float, k: int = 5, key: str = "chunk_id", dimensions: int = DIMENSIONS, keep: int = KEEP) -> DataFrame:
    """``(a, b, length)``: distinct pairs of keys that share a node and differ in few enough bits for the similarity, and of
    crowded vectors the ``k`` nearest in every node, with the longest common prefix of any tree.

    A pair exactly at ``min_similarity`` passes the screen in about 985 of 1,000 trees that it meets in.  Without bits all
    vectors are one node and are compared exactly.
    """
    if not bits:
        whole = units.select(F.lit(0).cast("bigint").alias("node"), F.col(key).alias("a"), "v")
        return whole.repartition(1).mapInArrow(_exact(k, min_similarity), "a bigint, b bigint, length int").distinct()
    projections = planes(dimensions, trees)
    drawn = units.select("v").sample(min(1.0, SAMPLE / max(n, 1)), seed=SEED).limit(2 * SAMPLE).collect()
    full = full_nodes(np.array([r.v for r in drawn], dtype=np.float32).reshape(-1, dimensions), n, projections, bits, trees)
    rows = units.mapInArrow(_tree_rows(projections, bits, trees, full), "node bigint, string bigint, id bigint, sketch bigint")
    arrays = rows.repartition("node").sortWithinPartitions("node", "string")
    chance, free = math.acos(max(-1.0, min(1.0, min_similarity))) / math.pi, 128 - bits
    most_bits = free * chance + SLACK * math.sqrt(free * chance * (1 - chance))
    met = stored(arrays.mapInArrow(_meet(keep, most_bits), "a bigint, b bigint, length int, node bigint"))
    pairs, crowd = met.where("b is not null").select("a", "b", "length"), met.where("b is null").select("node", "a")
    crowded = crowd.count()
    if crowded:
        # A few rows go to the vectors rather than all vectors to them.
        few = F.broadcast(crowd) if crowded <= BROADCAST else crowd
        theirs = units.select(F.col(key).alias("a"), "v").join(few, "a").select("node", "a", "v")
        pairs = pairs.unionByName(theirs.repartition("node").sortWithinPartitions("node").mapInArrow(_exact(k, min_similarity), "a bigint, b bigint, length int"))
    return pairs.groupBy("a", "b").agg(F.max("length").alias("length"))


def _ranked(close: DataFrame, k: int, key: str) -> DataFrame:
    both = close.select(F.inline(F.array(F.struct(F.col("a").alias(key), F.col("b").alias("neighbor"), "similarity"), F.struct(F.col("b").alias(key), F.col("a").alias("neighbor"), "similarity"))))
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbor")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def settled_from(length: int, trees: int, recall: float) -> float:
    """The least similarity at which a pair shares a prefix of this length in one of the trees with the target probability."""
    agree = (1 - (1 - recall) ** (1 / trees)) ** (1 / length) if length else 0.0
    return math.cos(math.pi * (1 - agree))


def nearest(vectors: DataFrame, k: int = 5, min_similarity: float = 0.85, key: str = "chunk_id", column: str = "embedding", dimensions: int = DIMENSIONS, recall: float = RECALL) -> DataFrame:
    """``(key, neighbor, similarity, rank)``: for every vector its ``k`` nearest by cosine, from ``min_similarity`` on.

    Every vector is indexed; the cosine is exact, the search approximate: a pair at ``min_similarity`` is met with the
    probability ``recall``, more similar ones with a higher one.  Equal cosines are ranked by the neighbour's key.  Keys
    are integers.
    """
    units = bucketed(usable(vectors, key, column, dimensions), key, placed=True)
    n = units.count()
    bits, trees = forest_shape(n, min_similarity, recall)
    pairs = stored(candidate_pairs(units, bits, trees, n, min_similarity, k, key, dimensions))
    left, right = units.select(F.col(key).alias("a"), F.col("v").alias("va")), units.select(F.col(key).alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    close = settled = None
    upto = 65
    for length in [bits + ASCENT * i for i in range(ASCENTS, 0, -1)] + [0] if bits else [0]:
        asked = pairs.where((F.col("length") >= length) & (F.col("length") < upto)).select("a", "b")
        if settled is not None:
            # What neither side still looks for is left out.
            mark = settled.withColumn("_done", F.lit(True))
            asked = asked.join(mark.withColumnRenamed(key, "a").withColumnRenamed("_done", "_a"), "a", "left").join(mark.withColumnRenamed(key, "b").withColumnRenamed("_done", "_b"), "b", "left").where("_a is null or _b is null").select("a", "b")
        found = stored(asked.join(left, "a").join(right, "b").select("a", "b", dot.alias("similarity")).where(F.col("similarity") >= min_similarity))
        close = found if close is None else close.unionByName(found)
        if length:
            sure = close.where(F.col("similarity") >= settled_from(length, trees, recall)).select(F.explode(F.array("a", "b")).alias(key))
            settled = stored(sure.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(key))
        upto = length
    return _ranked(close, k, key)


def mutual_pairs(neighbors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key_a, key_b)``: the pairs in which at least one is a neighbour of the other, the smaller key first."""
    return neighbors.select(F.least(key, "neighbor").alias(f"{key[:-3]}_a"), F.greatest(key, "neighbor").alias(f"{key[:-3]}_b")).distinct()

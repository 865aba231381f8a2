"""Problem 6: chunks that are edited copies of one another, by a MinHash LSH forest with exact verification.

A chunk is the set of its word shingles.  Chunks with the same set are one class and only one of them is compared.  A
tree of the forest gives each class a string of minimum hashes; sorted, the strings are a prefix trie.  Matching starts
from the longest prefix.  What matches is verified on the shingle sets themselves, and from the similarities that are
found follows which share of all links this length finds; while that is below the target, the prefix is shortened by one
hash and the pairs that match only now are verified.  ``prefix_length`` is the shortest prefix that is ever needed: with
it, a pair just at the threshold is a candidate with the probability ``FLOOR``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import bucketed
from quern.session import cut

#: Shingles of this many words; pairs from this similarity on.
SHINGLE = 3
THRESHOLD = 0.6
#: Trees of the forest, and the hashes that a tree's string has beyond the shortest prefix, of so many bits each.
TREES = 24
LEVELS = 3
LEVEL_BITS = 21
#: The probability with which a pair at the threshold is a candidate at the shortest prefix.
FLOOR = 0.99
#: The share of all links at which prefixes are no longer shortened.
RECALL = 0.999
SEED = 7
#: Bits of the filter that is sent to all workers (2 MB).
FILTER_BITS = 1 << 24

_WORDS = re.compile(r"[A-Za-z0-9_]+").findall


def prefix_length(threshold: float, trees: int = TREES, floor: float = FLOOR, longest: int = 32) -> int:
    """The longest prefix with which a pair at the threshold meets in one of the trees with the probability ``floor``."""
    return next((r for r in range(longest, 0, -1) if 1 - (1 - threshold**r) ** trees >= floor), 1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str, codes: dict[str, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; words are lower-cased runs of ASCII letters, digits and underscore."""
    words = _WORDS(text)
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(codes.__getitem__, " ".join(words).lower().split(" ")), dtype=np.uint64, count=len(words))
    mixed = h[:n].copy()
    for i in range(1, size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += h[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minimum_hashes(flat: np.ndarray, starts: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` minimum hashes (32 bits) of each of the non-empty sets that begin at ``starts`` in ``flat``."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size=count, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size=count, dtype=np.uint64)
    out = np.empty((count, len(starts)), dtype=np.uint32)
    for i in range(count):
        out[i] = np.minimum.reduceat(((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _forest_rows(key: str, trees: int, least: int, size: int):
    length = least + LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordHashes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 2000):
                part = texts[at : at + 2000]
                sets = [shingle_hashes(t, codes, size) for t in part]
                if len(codes) > 2_000_000:
                    codes.clear()
                # The class: equal sets, or for texts too short for a shingle equal texts.
                digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else xxhash.xxh128_digest(t.encode("utf-8", "replace"), seed=1) for s, t in zip(sets, part)]
                full = np.flatnonzero([len(s) > 0 for s in sets])
                prefixes, tails = np.zeros((2, len(part), trees), dtype=np.int64)
                if len(full):
                    lengths = np.array([len(sets[i]) for i in full])
                    minima = minimum_hashes(np.concatenate([sets[i] for i in full]), np.cumsum(lengths) - lengths, trees * length)
                    for t in range(trees):
                        mixed = np.full(len(full), t + 1, dtype=np.uint64)
                        for j in range(least):
                            mixed = (mixed ^ minima[t * length + j]) * np.uint64(0x9E3779B97F4A7C15)
                            mixed ^= mixed >> np.uint64(31)
                        prefixes[full, t] = mixed.view(np.int64)
                        for j in range(least, length):
                            tails[full, t] = tails[full, t] << LEVEL_BITS | minima[t * length + j] >> (32 - LEVEL_BITS)
                offsets = np.where(np.isin(np.arange(len(part)), full), trees, 0).cumsum()
                strings = pa.StructArray.from_arrays([pa.array(prefixes[full].ravel()), pa.array(tails[full].ravel())], names=["node", "tail"])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], offsets]).astype(np.int32), strings)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), pa.array(digests, pa.binary()), lists], names=[key, "class", "strings"])

    return run


def _shingle_rows(key: str, size: int, bitmap: bytes):
    bits = np.frombuffer(bitmap, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordHashes()
        for batch in batches:
            bit = batch.column(2).to_numpy()
            asked = pa.array(np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1))
            sets = [shingle_hashes(t, codes, size).view(np.int64) for t in batch.column(1).take(asked).to_pylist()]
            if len(codes) > 2_000_000:
                codes.clear()
            edges = np.cumsum([0, *(len(s) for s in sets)])
            lists = pa.ListArray.from_arrays(edges.astype(np.int32), np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(asked), lists], names=[key, "shingles"])

    return run


def classes(chunks: DataFrame, threshold: float = THRESHOLD, key: str = "chunk_id", text: str = "content", size: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """``(key, class, strings)``: each key once, with the class of its set and its string in every tree.

    A string is the node of its shortest prefix, which carries the tree, and the hashes that follow.  Rows without a key
    and null or blank texts take no part.  Repeated rows of one key count once.
    """
    rows = chunks.select(F.col(key), F.col(text).alias("_text")).where(F.col(key).isNotNull() & F.col("_text").rlike(r"\S"))
    kind = chunks.schema[key].dataType.simpleString()
    made = rows.mapInArrow(_forest_rows(key, trees, prefix_length(threshold, trees), size), f"`{key}` {kind}, class binary, strings array<struct<node:bigint,tail:bigint>>")
    return made.groupBy(key).agg(F.min(F.struct("class", "strings")).alias("_m")).select(key, "_m.class", "_m.strings")


def trie_pairs(node: np.ndarray, tail: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, length)`` of the places in the sorted strings that share a node, with the length of their common prefix."""
    i, step = np.arange(len(node) - 1), 1
    while len(i):
        i = i[node[i] == node[np.minimum(i + step, len(node) - 1)]]
        i = i[i + step < len(node)]
        if len(i):
            differ = tail[i] ^ tail[i + step]
            length = least + sum((differ < 1 << (LEVEL_BITS * k)).astype(np.int32) for k in range(LEVELS))
            yield i, i + step, length.astype(np.int32)
        step += 1


def _tries(least: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            node, tail, head = (table.column(i).to_numpy() for i in range(3))
            for i, j, length in trie_pairs(node, tail, least):
                a, b = head[i], head[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind), pa.array(length)], names=["head_a", "head_b", "length"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # The last node may go on in the next batch.
            if held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column(0).to_numpy()
            edge = len(node) - int(np.argmax(node[::-1] != node[-1]))
            yield from pairs(table.slice(0, edge))
            held = table.slice(edge).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def candidate_pairs(members: DataFrame, least: int, key: str = "chunk_id") -> DataFrame:
    """``(head_a, head_b, length)``: the pairs of classes, by their smallest keys, that share a node of some tree, and their longest common prefix.

    The trees' strings are sorted within the nodes of the shortest prefix, so every longer match is a stretch of a node.
    Keys are integers.
    """
    heads = members.groupBy("class").agg(F.min(F.struct(F.col(key), "strings")).alias("_h")).select(F.col(f"_h.{key}").alias("head"), "_h.strings")
    strings = heads.select(F.inline("strings"), "head").select("node", "tail", F.col("head").cast("bigint"))
    tries = strings.repartition("node").sortWithinPartitions("node", "tail")
    return tries.mapInArrow(_tries(least, pa.int64()), "head_a bigint, head_b bigint, length int").groupBy("head_a", "head_b").agg(F.max("length").alias("length"))


def _bitmap(keys: DataFrame, key: str) -> tuple[Column, bytes]:
    """``(bit of a key, bits of all keys)``: a filter of ``FILTER_BITS``, whatever the number of keys."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    word = 32_768  # bits of one bitmap of the aggregate function
    parts = keys.select(bit.alias("b")).groupBy(F.floor(F.col("b") / word).alias("w")).agg(F.bitmap_construct_agg(F.col("b") % word).alias("m")).collect()
    held = {r.w: bytes(r.m) for r in parts}
    return bit, b"".join(held.get(w, bytes(word // 8)) for w in range(FILTER_BITS // word))


def shingle_sets(chunks: DataFrame, pairs: DataFrame, key: str = "chunk_id", text: str = "content", size: int = SHINGLE) -> DataFrame:
    """``(head, shingles)`` of the classes that occur in the pairs, in buckets of ``head``.

    Texts that no pair asks for are passed over where they are read, by a filter of fixed size; what that lets through in
    error is dropped by an exact join of the sets.
    """
    wanted = cut(pairs.select(F.explode(F.array("head_a", "head_b")).alias("head")).distinct())
    bit, bitmap = _bitmap(wanted, "head")
    texts = chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("head"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    sets = texts.select("head", "_text", bit).mapInArrow(_shingle_rows("head", size, bitmap), "head bigint, shingles array<bigint>")
    return bucketed(sets.join(wanted, "head", "left_semi").dropDuplicates(["head"]), "head")


def similar_heads(sets: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(head_a, head_b, similarity)`` of the pairs whose sets are at least so similar, by exact intersection."""
    left, right = sets.select(F.col("head").alias("head_a"), F.col("shingles").alias("_a")), sets.select(F.col("head").alias("head_b"), F.col("shingles").alias("_b"))
    both = pairs.select("head_a", "head_b").join(left, "head_a").join(right, "head_b")
    shared = F.size(F.array_intersect("_a", "_b"))
    similarity = shared / (F.size("_a") + F.size("_b") - shared)
    return both.select("head_a", "head_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def found_share(links: DataFrame, length: int, trees: int) -> float:
    """The share of all links that prefixes of this length find, estimated from the links found: each stands for as many as
    its similarity would need to be found once.  0 without links."""
    chance = 1 - F.pow(1 - F.pow("similarity", F.lit(length)), F.lit(trees))
    n, total = links.agg(F.count(F.lit(1)), F.sum(1 / chance)).collect()[0]
    return n / total if n else 0.0


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD, key: str = "chunk_id", text: str = "content", size: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``(key, head)`` with the class head of every key, and ``(head_a, head_b, similarity)``.

    The links join class heads only; copies are members of one class and need no links.  Together they lose no pair that
    the forest finds, and nothing is capped.
    """
    made = cut(classes(chunks, threshold, key, text, size, trees))
    heads = made.groupBy("class").agg(F.min(key).alias("head"))
    members = made.select(key, "class").join(heads, "class").select(key, "head")
    least = prefix_length(threshold, trees)
    pairs = cut(candidate_pairs(made, least, key))
    sets = shingle_sets(chunks, pairs, key, text, size)
    links = None
    for length in range(least + LEVELS, least - 1, -1):
        matched = cut(similar_heads(sets, pairs.where(F.col("length") == length), threshold))
        links = matched if links is None else links.unionByName(matched)
        if length > least and found_share(links, length, trees) >= recall:
            break
    return members, links


def all_pairs(members: DataFrame, links: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key_a, key_b)``: every pair of similar keys, copies expanded, the smaller key first."""
    a, b = members.select(F.col(key).alias("x"), F.col("head").alias("head_a")), members.select(F.col(key).alias("y"), F.col("head").alias("head_b"))
    across = links.join(a, "head_a").join(b, "head_b").select("x", "y")
    within = a.join(b, (F.col("head_a") == F.col("head_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(f"{key[:-3]}_a"), F.greatest("x", "y").alias(f"{key[:-3]}_b"))


def groups(members: DataFrame, links: DataFrame, key: str = "chunk_id", rounds: int = 50) -> DataFrame:
    """``(key, group_id, links)``: connected groups, named by their smallest key, and each key's number of links to other classes.

    Every round a class takes the smallest label among its neighbours and passes it to the row of its old label too, so that
    whole groups hook onto each other, and then takes its label's own label.  It stops when no label changes, which is when
    the ends of every link have the same label; if ``rounds`` do not reach that, it raises an error.  A key without a
    partner is its own group.
    """
    both = links.select(F.col("head_a").alias("u"), F.col("head_b").alias("v")).unionByName(links.select(F.col("head_b").alias("u"), F.col("head_a").alias("v")))
    edges = cut(both.distinct())
    labels = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
    labels = cut(labels)
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        offers = labels.join(near, "u").select(F.inline(F.array(F.struct("u", F.least("label", "near").alias("offer")), F.struct(F.col("label").alias("u"), F.col("near").alias("offer")))))
        step = cut(labels.join(offers.groupBy("u").agg(F.min("offer").alias("offer")), "u").select("u", "label", F.least("label", "offer").alias("next")))
        jump = step.join(step.select(F.col("u").alias("next"), F.col("next").alias("far")), "next")
        moved = cut(jump.select("u", F.least("next", "far").alias("next"), "label"))
        labels = moved.select("u", F.col("next").alias("label"))
        if moved.where("next <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"groups are not settled after {rounds} rounds")
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    named = labels.join(degree, "u").withColumnRenamed("u", "head")
    return members.join(named, "head", "left").select(key, F.coalesce("label", "head").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

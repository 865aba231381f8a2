"""Problem 9: texts into containers of fixed token capacity, for each capacity, with as little room left as possible.

The plan needs only how many items there are of each size, a table bounded by the capacity.  It routes the sizes to tiers,
the context sizes of a capacity and its halves: an item belongs to the smallest that holds it.  From the longest tier
down each tier is packed on its own, then what its containers leave open is filled from the shorter tiers, preferring
sizes that close a gap exactly.  The rows then find their containers by their rank within their size, so no container and
no size is ever gathered in one place.  Steps group containers so that their loads are balanced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.session import cut

#: Containers of one step.
STEP = 8

Entry = tuple[int, int, int, int]  # size, first rank, containers, first container
Run = tuple[int, int, int]  # first container, containers, load of each


def tier_of(size: int, capacity: int) -> int:
    """The tier whose context size is the least that holds the item: 0 for the capacity, 1 for half of it, and so on."""
    return max(0, (capacity // size).bit_length() - 1) if size else capacity.bit_length()


class _Stock:
    """Items left of each size, and the ranks that are given out."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left, self.used = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)

    def filler(self, gap: int, low: int, high: int) -> tuple[int, ...]:
        """Of the sizes from ``low`` to ``high``: the one or two that close the gap, else the largest that fits."""
        high = min(high, gap)
        if low > high:
            return ()
        if high == gap and self.left[gap]:
            return (gap,)
        have = self.left[low : high + 1] > 0
        longer = np.arange(max(low, (gap + 1) // 2), min(high, gap - low) + 1)
        pair = longer[have[longer - low] & have[gap - longer - low] & ((longer * 2 != gap) | (self.left[longer] > 1))]
        if len(pair):
            return int(pair[-1]), int(gap - pair[-1])
        fits = np.flatnonzero(have)
        return (int(fits[-1]) + low,) if len(fits) else ()

    def fill(self, looks: list[tuple[int, int, tuple[int, ...]]], capacity: int, low: int, high: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Containers of one look, ``(containers, load, sizes inside)``, after items from ``low`` to ``high`` have joined them."""
        todo, closed = looks[::-1], []
        while todo:
            n, load, inside = todo.pop()
            chosen = self.filler(capacity - load, low, high) if load < capacity else ()
            if not chosen:
                closed.append((n, load, inside))
                continue
            m = min(n, *(int(self.left[s]) // chosen.count(s) for s in set(chosen)))
            for s in chosen:
                self.left[s] -= m
            if n > m:
                todo.append((n - m, load, inside))
            todo.append((m, load + sum(chosen), (*inside, *chosen)))
        return closed


def plan(counts: np.ndarray, capacity: int) -> tuple[list[Entry], list[Run]]:
    """``(entries, runs)`` for ``counts[s]`` items of each size s up to the capacity.

    An entry says that the items of a size from a rank on go one by one into so many successive containers, a run that so
    many successive containers have the same load.  Containers of one look are opened together, so the steps and the
    memory follow the number of sizes, not of items.
    """
    stock, entries, runs, opened = _Stock(counts), [], [], 0
    for tier in range(capacity.bit_length()):
        low, high = capacity // 2 ** (tier + 1) + 1, capacity // 2**tier
        looks: list[tuple[int, int, tuple[int, ...]]] = []
        for size in range(high, low - 1, -1):
            if stock.left[size]:
                n, stock.left[size] = int(stock.left[size]), 0
                # Items of one size that are too short to stand alone share containers among themselves first.
                each = capacity // size
                whole, rest = divmod(n, each)
                looks += stock.fill([(k, size * m, (size,) * m) for k, m in ((whole, each), (1 if rest else 0, rest)) if k], capacity, low, size)
        for n, load, inside in stock.fill(looks, capacity, 1, low - 1):
            for s in inside:
                entries.append((s, int(stock.used[s]), n, opened))
                stock.used[s] += n
            runs.append((opened, n, load))
            opened += n
    return entries, runs


def load_places(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """``(first, place)`` of every run: its first container, and where that stands among all by falling load."""
    first, n, load = (np.array(x, dtype=np.int64) for x in zip(*runs)) if runs else (np.zeros(0, dtype=np.int64),) * 3
    order = np.argsort(-load, kind="stable")
    place = np.empty(len(first), dtype=np.int64)
    place[order] = np.cumsum(n[order]) - n[order]
    return first, place


def _lookup(plans: dict[int, list[Entry]]):
    """Containers of (capacity_id, size, rank), by binary search in the plan."""
    table = {}
    for capacity_id, entries in plans.items():
        by_size: dict[int, list[Entry]] = {}
        for e in entries:
            by_size.setdefault(e[0], []).append(e)
        table[capacity_id] = {s: (np.array([e[1] for e in es]), np.array([e[3] for e in es])) for s, es in by_size.items()}

    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for capacity_id, size, rank in batches:
            out = np.full(len(size), -1, dtype=np.int64)
            groups = pd.DataFrame({"c": capacity_id, "s": size}).groupby(["c", "s"], sort=False).indices
            for (c, s), rows in groups.items():
                if s > 0:
                    ranks, first = table[c][s]
                    r = rank.to_numpy()[rows]
                    at = np.searchsorted(ranks, r, side="right") - 1
                    out[rows] = first[at] + r - ranks[at]
            yield pd.Series(out)

    return find


def _places(runs: dict[int, list[Run]]):
    """Where the containers of (capacity_id, container_id) stand by falling load."""
    table = {c: load_places(r) for c, r in runs.items()}

    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for capacity_id, container in batches:
            out, asked = container.to_numpy(dtype=np.int64).copy(), capacity_id.to_numpy()
            for c in np.unique(asked):
                first, place = table[c]
                rows = np.flatnonzero(asked == c)
                at = np.searchsorted(first, out[rows], side="right") - 1
                if len(first):
                    out[rows] += place[at] - first[at]
            yield pd.Series(out)

    return find


def pack(documents: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """``pack_sizes`` of the texts' numbers of tokens."""
    return pack_sizes(cut(bpe.count_tokens(documents, key, text, tokenizer)), capacities, key)


def pack_sizes(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(capacity_id, container_id, step, key, piece, start, tokens)``: every item in containers of every capacity.

    ``sizes`` is ``(key, tokens)`` with one row per item; repeated rows are items of their own.  Only an item above the
    capacity is divided: into pieces that fill a container each, and a rest that is packed like any item.  Items without
    tokens (also null ones) take no room and are spread over the containers.  ``step`` groups about ``STEP`` containers;
    dealt out to and fro by falling load, no two steps differ by more than one container's load.  Rows of capacities without a positive size are left out, and of a repeated capacity_id the
    largest.  ``capacities`` is a small table of settings and is read to the driver, as is one count per size up to each
    capacity.
    """
    spark = sizes.sparkSession
    kinds = {r.capacity_id: r.tokens for r in capacities.where("tokens > 0 and capacity_id is not null").groupBy("capacity_id").agg(F.max("tokens").alias("tokens")).collect()}
    settings = F.array(*(F.struct(F.lit(c).cast("bigint").alias("capacity_id"), F.lit(int(t)).cast("bigint").alias("_cap")) for c, t in sorted(kinds.items()))) if kinds else None
    out = f"capacity_id bigint, container_id bigint, step bigint, `{key}` {sizes.schema[key].dataType.simpleString()}, piece bigint, start bigint, tokens bigint"
    if settings is None:
        return spark.createDataFrame([], out)
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    items = (
        sizes.select(F.col(key), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("_all"))
        .select(key, "_all", F.inline(settings))
        .withColumn("_full", F.when(F.col("_all") > F.col("_cap"), F.floor(F.col("_all") / F.col("_cap"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("_rest", F.col("_all") - F.col("_full") * F.col("_cap"))
        .withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)))
    )
    # An item that its full pieces use up leaves no rest; an empty item is a rest of size 0.
    rests = items.where("_rest > 0 or _full = 0")
    by_salt = rests.groupBy("capacity_id", "_rest", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    full_by_salt = items.groupBy("capacity_id", "_salt").agg(F.sum("_full").alias("_n"))
    counts = by_salt.groupBy("capacity_id", "_rest").agg(F.sum("_n").alias("n")).collect()
    plans, opened, runs = {}, {}, {}
    for c, capacity in kinds.items():
        histogram = np.zeros(int(capacity) + 1, dtype=np.int64)
        for r in counts:
            if r.capacity_id == c:
                histogram[r._rest] = r.n
        plans[c], runs[c] = plan(histogram, int(capacity))
        opened[c] = sum(n for _, n, _ in runs[c]) or int(histogram[0] > 0)
    of = lambda values: F.create_map(*(x for c, v in values.items() for x in (F.lit(c).cast("bigint"), F.lit(int(v)).cast("bigint"))))[F.col("capacity_id")]
    before = Window.partitionBy("capacity_id", "_rest").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("capacity_id", "_rest", "_salt").orderBy(key)
    find = F.pandas_udf(_lookup(plans), "bigint")
    planned = (
        rests.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["capacity_id", "_rest", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .withColumn("container_id", F.when(F.col("_rest") > 0, find("capacity_id", "_rest", "_rank")).otherwise(F.pmod("_rank", F.greatest(of(opened), F.lit(1)))))
        .select("capacity_id", "container_id", key, F.col("_full").alias("piece"), (F.col("_full") * F.col("_cap")).alias("start"), F.col("_rest").alias("tokens"))
    )
    full_before = Window.partitionBy("capacity_id").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    full_offsets = full_by_salt.withColumn("_before", F.coalesce(F.sum("_n").over(full_before), F.lit(0))).drop("_n")
    running = Window.partitionBy("capacity_id", "_salt").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    full = (
        items.withColumn("_own", F.coalesce(F.sum("_full").over(running), F.lit(0)))
        .where("_full > 0")
        .join(full_offsets, ["capacity_id", "_salt"])
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)))
        .select("capacity_id", (of(opened) + F.col("_before") + F.col("_own") + F.col("piece")).alias("container_id"), key, "piece", (F.col("piece") * F.col("_cap")).alias("start"), F.col("_cap").alias("tokens"))
    )
    # By falling load: first the pieces that fill a container, then the planned containers.
    filled = {r.capacity_id: r.n for r in full_by_salt.groupBy("capacity_id").agg(F.sum("_n").alias("n")).collect()}
    fulls = {c: int(filled.get(c, 0)) for c in kinds}
    by_load = F.pandas_udf(_places(runs), "bigint")
    placed = planned.withColumn("_place", of(fulls) + by_load("capacity_id", "container_id")).unionByName(full.withColumn("_place", F.col("container_id") - of(opened)))
    steps_all = F.greatest(F.ceil((of(opened) + of(fulls)) / F.lit(STEP)), F.lit(1)).cast("bigint")
    lap, at = F.floor(F.col("_place") / steps_all), F.pmod(F.col("_place"), steps_all)
    dealt = F.when(lap % 2 == 0, at).otherwise(steps_all - 1 - at)
    return placed.select("capacity_id", "container_id", dealt.cast("bigint").alias("step"), key, "piece", "start", "tokens")


def room_left(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(capacity_id, containers, tokens, room_share)``: what each capacity's containers leave empty."""
    filled = packed.groupBy("capacity_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    caps = capacities.groupBy("capacity_id").agg(F.max("tokens").alias("_cap"))
    return filled.join(caps, "capacity_id").select("capacity_id", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("_cap")), 9).alias("room_share"))

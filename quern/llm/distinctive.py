"""Problem 3: how characteristic a term is of a chunk, by hypergeometric enrichment.

A chunk of ``n`` occurrences is a draw from the ``N`` occurrences of the collection, ``K`` of which are the term.  The
score is the negative decimal logarithm of the exact probability of at least the seen count ``k``, adjusted for false
discoveries (Benjamini and Hochberg) over the terms of the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.packed import term_totals
from quern.llm.term_counts import distinct_postings

#: Coefficients of the Stirling series of log-gamma.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma of an array of positive numbers, to about 1e-13: the argument is raised to at least 8, then Stirling."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    inverse, power, series = 1 / (y * y), 1 / y, np.zeros_like(y)
    for c in _STIRLING:
        series += c * power
        power = power * inverse
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def upper_tail_log10(k: np.ndarray, n: np.ndarray, big_k: np.ndarray, big_n: np.ndarray) -> np.ndarray:
    """log10 P(X >= k) for X hypergeometric: n drawn of big_n, big_k of which are marked.

    The mass at k comes from log-gamma sums, the masses above it from the ratio of neighbours, until they no longer
    change the sum.  Below the mean the masses rise first, so a sum stops only once they fall.
    """
    k, n, big_k, big_n = (np.asarray(a, dtype=np.float64) for a in (k, n, big_k, big_n))
    # Fewer marked ones than the draw must hold cannot come out: there the probability is 1, as it is at the least number.
    k = np.maximum(k, n + big_k - big_n)
    first = log_choose(big_k, k) + log_choose(big_n - big_k, n - k) - log_choose(big_n, n)
    total, mass = np.ones_like(first), np.ones_like(first)
    active, at = np.arange(len(first)), k.copy()
    while len(active):
        i, kk, nn, nk = at[active], big_k[active], n[active], big_n[active]
        ratio = (kk - i) * (nn - i) / ((i + 1) * (nk - kk - nn + i + 1))
        # Sums are kept relative to the first mass and rescaled where they would overflow.
        mass[active] *= ratio
        total[active] += mass[active]
        at[active] += 1
        large = active[total[active] > 1e200]
        first[large] += np.log(1e200)
        total[large] /= 1e200
        mass[large] /= 1e200
        more = (mass[active] > total[active] * 1e-17) & (at[active] < np.minimum(kk, nn))
        active = active[more]
    return np.minimum((first + np.log(total)) / np.log(10), 0.0)


def _tails(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for k, n, big_k, big_n in batches:
        yield pd.Series(-upper_tail_log10(k.to_numpy(), n.to_numpy(), big_k.to_numpy(), big_n.to_numpy()) + 0.0)


def term_scores(postings: DataFrame, doc_stats: DataFrame, index_stats: DataFrame, only: DataFrame | None = None, posting_rows: int | None = None) -> DataFrame:
    """``(chunk_id, term, tf, surprise, score)`` for every term of every chunk, or of the chunks in ``only``.

    ``surprise`` is -log10 of the exact tail probability and ``score`` the same after the false-discovery adjustment.
    Corpus figures always come from all postings.  Repeated rows count once and a null tf as one.  A missing or too
    small doc_len is replaced by the chunk's own count, and N by what K and n need if the index statistics are stale.
    Ties are left as ties.  Empty inputs give no rows.  ``posting_rows`` is about the number of postings, as in
    ``term_totals``.
    """
    totals = term_totals(postings, posting_rows).select("term", F.col("occurrences").alias("_K"))
    size = index_stats.dropDuplicates(["index_id"]).agg(F.coalesce(F.sum(F.col("doc_count") * F.col("avg_doc_len")), F.lit(0.0))).scalar()
    if only is None:
        rows = distinct_postings(postings)
    else:
        asked = only.select("chunk_id").where("chunk_id is not null").distinct()
        rows = distinct_postings(postings.join(asked, "chunk_id", "left_semi"))
    lengths = doc_stats.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("doc_len").alias("_len"))
    chunk = Window.partitionBy("chunk_id")
    scored = (
        rows.join(totals, "term")
        .join(lengths, "chunk_id", "left")
        .withColumn("_n", F.greatest(F.coalesce("_len", F.lit(0)), F.sum("tf").over(chunk)).cast("double"))
        .withColumn("_m", F.count(F.lit(1)).over(chunk))
    )
    k, big_k = F.col("tf").cast("double"), F.col("_K").cast("double")
    big_n = F.greatest(F.round(size), F.col("_n") + F.col("_K") - F.col("tf"))
    tails = F.pandas_udf(_tails, "double")
    worst = chunk.orderBy("surprise").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        scored.withColumn("surprise", tails(k, F.col("_n"), big_k, big_n))
        .withColumn("_rank", F.col("_m") - F.rank().over(chunk.orderBy("surprise")) + 1)
        # -log10(m p / rank), made monotone from the least surprising term up.
        .withColumn("score", F.greatest(F.max(F.col("surprise") - F.log10(F.col("_m") / F.col("_rank"))).over(worst), F.lit(0.0)))
        .select("chunk_id", "term", "tf", "surprise", "score")
    )


def most_distinctive(scores: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` first terms of every chunk by score, then surprise, then the term itself."""
    order = Window.partitionBy("chunk_id").orderBy(F.desc("score"), F.desc("surprise"), "term")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Problem 10: how much of a text repeats what the same text said before, and what that says of its source.

Each text is measured on its own; rules turn the measures into failures; failure rates per source are shrunk with a beta
prior that is fitted to all sources, and the source's verdict is joined back to its documents.  A document that fails a
rule itself or comes from a suspect source is then judged by the exact share of its repeated words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

#: A run of this many words is a repetition.
RUN = 4
#: From this share of repeated words on, a text fails; below so many words it is no case.
FAILS_FROM = 0.40
LEAST_WORDS = 20
#: Rules: a text fails one from this share of repeated words on, the other if this share of its lines (so many at least)
#: stood in it before.  Both are weaker than the final judgement, so that no case passes both.
RULE_FROM = 0.20
LINES_FROM = 0.50
LEAST_LINES = 4
#: The shrunk failure rate from which a source as a whole is suspect.
SUSPECT_FROM = 0.30

_WORDS = regex.compile(r"\p{L}+").findall


def repeated_words(words: list[str], run: int = RUN) -> int:
    """The words that stand in a run of ``run`` words that began earlier in the list too; the two may overlap."""
    n = len(words) - run + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    key = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    if len(codes) == len(words):
        return 0
    width, base = 1, len(codes)
    while width < run:
        # Numbers of runs of `width` words become those of longer runs; renumbered each time, so they stay exact.
        step = min(width, run - width)
        key = key[: len(key) - step] * base + key[step:]
        _, first, key = np.unique(key, return_index=True, return_inverse=True)
        width, base = width + step, len(first)
    if len(first) == n:
        return 0
    again = first[key] != np.arange(n)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += again
    edges[run : run + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            # Cut before the case is dropped, which can turn one letter into two characters.
            words = " ".join(_WORDS(text)).lower().split() if text else []
            lines = [x for x in map(str.strip, text.splitlines()) if x] if text else []
            rows.append((len(words), repeated_words(words), len(lines), len(lines) - len(set(lines))))
        measures = np.array(rows, dtype=np.int64).reshape(-1, 4)
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(measures[:, i]) for i in range(4))], names=[*names, "words", "repeated", "lines", "repeated_lines"])


def measure(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, words, repeated, lines, repeated_lines)`` of every row; a null or empty text has none of them."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(_measure, f"doc_id {kind}, source string, words bigint, repeated bigint, lines bigint, repeated_lines bigint")


def host_rates(measured: DataFrame) -> DataFrame:
    """``(source, documents, failures, rate)``: failure rates, shrunk by a beta prior fitted to all sources by moments.

    With one source only, or no spread between sources, the prior weighs as much as an average source.
    """
    fails = F.col("fails").cast("int")
    hosts = measured.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(fails).cast("bigint").alias("failures"))
    rate = F.col("failures") / F.col("documents")
    prior = hosts.agg(
        F.coalesce(F.sum("failures") / F.sum("documents"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("variance"),
        F.coalesce(F.avg("documents"), F.lit(1.0)).alias("size"),
    )
    # Of the variance between rates, the part that sampling alone would make is not the sources' own.
    noise = F.col("mean") * (1 - F.col("mean"))
    own = F.col("variance") - noise / F.col("size")
    strength = F.when(own > 0, F.greatest(noise / own - 1, F.lit(1.0))).otherwise(F.col("size"))
    mean, weight = prior.select("mean").scalar(), prior.select(strength).scalar()
    return hosts.withColumn("rate", (F.col("failures") + mean * weight) / (F.col("documents") + weight))


def assess(documents: DataFrame, fails_from: float = FAILS_FROM, least_words: int = LEAST_WORDS, suspect_from: float = SUSPECT_FROM) -> DataFrame:
    """``(doc_id, source, words, share, line_share, fails, source_rate, source_suspect, repetitive)``, one row per row.

    ``share`` is the share of words in repeated runs, 0 without words.  ``fails`` says whether a rule speaks against the
    document, ``source_rate`` is the shrunk rate of such documents in its source.  ``repetitive`` is the verdict: of the
    documents that fail or whose source is suspect, those with enough words and at least ``fails_from`` of them repeated.
    A document without a source has a null source_rate and no suspect source.  The measures are cut off before the
    rates, so that no text is read twice.
    """
    if fails_from < RULE_FROM:
        raise ValueError(f"fails_from is below the rule's {RULE_FROM}")
    measured = cut(measure(documents))
    share = F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(F.lit(0.0))
    line_share = F.when(F.col("lines") > 0, F.col("repeated_lines") / F.col("lines")).otherwise(F.lit(0.0))
    enough = F.col("words") >= least_words
    ruled = (
        measured.withColumn("share", share)
        .withColumn("line_share", line_share)
        .withColumn("fails", enough & ((F.col("share") >= RULE_FROM) | ((F.col("lines") >= LEAST_LINES) & (F.col("line_share") >= LINES_FROM))))
    )
    rates = host_rates(ruled).select("source", F.col("rate").alias("source_rate"))
    judged = ruled.join(rates, "source", "left").withColumn("source_suspect", F.coalesce(F.col("source_rate") >= suspect_from, F.lit(False)))
    repetitive = (F.col("fails") | F.col("source_suspect")) & enough & (F.col("share") >= fails_from)
    return judged.select("doc_id", "source", "words", "share", "line_share", "fails", "source_rate", "source_suspect", repetitive.alias("repetitive"))

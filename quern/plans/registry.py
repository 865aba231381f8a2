"""All queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dialect import DUCK, SPARK
from quern.operators.lookup import FIND_RELATED_SQL, related_chunks
from quern.plans.catalog import BY_HITS, CATALOG, INSTEAD
from quern.plans.runner import Run, duck_sql
from quern.session import table
from quern.sources.chunking import OUTLINED, chunk_files


def find_related(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest chunks of the same language for every chunk whose id is divisible by 50."""
    return related_chunks(table(spark, d, "vectors"), table(spark, d, "chunks"))


def _cut_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of code in a language with an outline, taken as a file and chunked along its structure."""
    rows = Run(spark, d).stage("chunk_rows").where(F.col("language").isin(*sorted(OUTLINED)) & F.col("content").isNotNull())
    return chunk_files(rows.select(F.col("chunk_id").cast("string").alias("file_path"), "language", "content"))


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """``(chunk_id, ordinal, start_line, end_line, content)``; pieces of white space alone are left out."""
    return _cut_chunks(spark, d).select(F.col("file_path").cast("bigint").alias("chunk_id"), "ordinal", "start_line", "end_line", "content")


def code_chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text hold together: all that is not white space, in order, from its first line to its last."""
    parts = code_chunks(spark, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content", "start_line", "end_line"))).alias("p"))
    whole = F.array_join("p.content", "")
    return parts.select("chunk_id", F.md5(F.regexp_replace(whole, "[ \t\r\n]+", "")).alias("digest"), F.element_at("p.start_line", 1).alias("first_line"))


CODE_CHUNK_COVER_SQL = """
SELECT chunk_id, md5(regexp_replace(content, '[ \t\r\n]+', '', 'g')) AS digest, CAST(1 AS BIGINT) AS first_line FROM (
  SELECT chunk_id, lower(language) AS language, content, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, lower(language) NULLS LAST) AS n FROM chunks WHERE chunk_id IS NOT NULL AND file_path IS NOT NULL) x
WHERE n = 1 AND language IN ({}) AND regexp_matches(content, '[^ \t\r\n]')
""".format(", ".join(f"'{x}'" for x in sorted(OUTLINED)))

#: Queries that SQL cannot state; ``code_chunk_cover`` states what can be.
WITHOUT_TWIN = {"code_chunks"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: lambda spark, d, f=f, instead=INSTEAD.get(name), by_hits=name in BY_HITS: Run(spark, d, instead).sql(f(SPARK), by_hits) for name, f in CATALOG.items()}
    return out | {"find_related": find_related, "code_chunks": code_chunks, "code_chunk_cover": code_chunk_cover}


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(f(DUCK), INSTEAD.get(name)) for name, f in CATALOG.items()} | {"find_related": FIND_RELATED_SQL, "code_chunk_cover": CODE_CHUNK_COVER_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid search for every logged query."""
    return Run(spark, sf_dir).sql(CATALOG["hybrid_search"](SPARK))

"""Chunks that are like a given chunk, by exact cosine of their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.dense import top_products
from quern.session import cut


def unit_vectors(vectors: DataFrame, key: str = "chunk_id", column: str = "embedding", dimensions: int = 64) -> DataFrame:
    """``(key, v)``: one unit vector per key; null, zero, shortened and not finite ones are left out."""
    v = F.col(column)
    sound = v.isNotNull() & (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col(key).isNotNull()).where(sound).groupBy(key).agg(F.min(v.cast("array<double>")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return kept.withColumn("_n", norm).select(key, F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def related_to(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: of every asked chunk the ``k`` most similar others of its language.

    Both are ``(chunk_id, v, language)`` with unit vectors; a chunk without a language has no relatives.
    """
    nothing = F.lit(None).cast("array<string>")
    queries = asked.where("language is not null").select(F.col("chunk_id").alias("query_id"), "v", F.lit(k + 1).cast("bigint").alias("k"), nothing.alias("languages"), nothing.alias("paths"), "language")
    vectors = rows.where("language is not null").select(F.col("chunk_id").alias("id"), "v", "language", F.lit(None).cast("string").alias("path"))
    found = top_products(vectors, queries, queries.count(), by="language").where("id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", F.col("id").alias("chunk_id"), "score", order.cast("bigint").alias("rank")).where(F.col("rank") <= k)


def related_chunks(vectors: DataFrame, chunks: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: for each asked chunk the most similar others of its language.

    Asked are the chunks whose id is divisible by ``every``, against all vectors.
    """
    languages = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.lower("language")).alias("language"))
    rows = cut(unit_vectors(vectors).join(languages, "chunk_id"))
    return related_to(rows.where(F.col("chunk_id") % every == 0), rows, k)


FIND_RELATED_SQL = """
WITH sound AS (
  SELECT chunk_id, min(CAST(embedding AS DOUBLE[])) AS v FROM vectors
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id
), units AS (
  SELECT s.chunk_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v, l.language FROM sound s
  JOIN (SELECT chunk_id, min(lower(language)) AS language FROM chunks GROUP BY chunk_id) l USING (chunk_id)
), scored AS (
  SELECT q.chunk_id AS query_id, c.chunk_id, round(list_inner_product(q.v, c.v), 6) AS score FROM units q JOIN units c ON q.language = c.language AND q.chunk_id <> c.chunk_id WHERE q.chunk_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored
) SELECT query_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5
"""

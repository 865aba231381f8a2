"""Queries of the ten problems over the test tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, distinctive, fusion, near_dup, neighbors, packing, repetition, source_files, splitting, term_counts
from quern.session import table, work_folder

Query = Callable[[SparkSession, str], DataFrame]


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return source_files.label_files(table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_labels(spark, d).where("label <> 'handwritten'").select("file_path")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.block_lines(splitting.pieces_by_chunk(table(spark, d, "chunks"), contents=False))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(table(spark, d, "chunks"))


def p2_joined(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized chunk what its pieces make without their repeated lines, and whether all of them fit."""
    own = F.array_join(F.slice(F.split("content", "\n"), F.col("repeated_lines").cast("int") + 1, F.greatest(F.size(F.split("content", "\n")), F.lit(1))), "\n")
    parts = p2_pieces(spark, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece", own.alias("own")))).alias("p"), (F.max(F.char_length("content")) <= splitting.LIMIT).alias("fits"))
    return parts.select("chunk_id", F.md5(F.array_join("p.own", "")).alias("digest"), "fits")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    postings = table(spark, d, "postings")
    scores = distinctive.term_scores(postings, table(spark, d, "doc_stats"), table(spark, d, "bm25_stats"), only=table(spark, d, "term_probes"), posting_rows=postings.count())
    return distinctive.most_distinctive(scores).select("chunk_id", "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    postings = table(spark, d, "postings")
    scores = distinctive.term_scores(postings, table(spark, d, "doc_stats"), table(spark, d, "bm25_stats"), posting_rows=postings.count())
    return scores.select("chunk_id", "term", F.col("tf").cast("bigint").alias("tf"), F.round("surprise", 3).alias("surprise"), F.round("score", 3).alias("score"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(table(spark, d, "rank_evidence"), table(spark, d, "queries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_ranking(spark, d).where("rank = 1 and retrievers >= 2").select("query_id", "chunk_id")


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest(table(spark, d, "vectors")).withColumn("similarity", F.round("similarity", 5))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.mutual_pairs(neighbors.nearest(table(spark, d, "vectors")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.all_pairs(*near_dup.near_duplicates(table(spark, d, "chunks")))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(*near_dup.near_duplicates(table(spark, d, "chunks")))


def _p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stored state after two batches: the records up to a high-water mark, then those that came after it."""
    postings = table(spark, d, "postings")
    # The middle of the known ids.
    mark = F.lit(table(spark, d, "doc_stats").agg(F.coalesce(F.percentile_approx("chunk_id", 0.5), F.lit(0)).alias("m")).collect()[0].m)
    rows = postings.count() // 2
    store = term_counts.CountStore(spark, f"{work_folder(spark)}/counts_{uuid.uuid4().hex}").apply(added=postings.where(F.col("chunk_id") <= mark), rows=rows).apply(added=postings.where(F.col("chunk_id") > mark), rows=rows)
    records = table(spark, d, "chunks").agg(F.count_distinct("chunk_id").alias("n")).collect()[0].n
    return term_counts.mark_terms(store.read(), records)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7_counts(spark, d).where("mark is not null").select("term", "mark")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p7_counts(spark, d)


def p7_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, reached by steps: one index after the other's rows, one batch added in error and deleted again."""
    postings, owner = table(spark, d, "postings"), table(spark, d, "doc_stats").select("chunk_id", "index_id").dropDuplicates(["chunk_id"])
    owned = postings.join(owner, "chunk_id", "left")
    odd, even = owned.where("index_id % 2 = 1"), owned.where("index_id % 2 = 0 or index_id is null")
    counts = term_counts.update_counts(None, added=odd)
    counts = term_counts.update_counts(counts, added=even)
    return term_counts.update_counts(counts, added=odd, deleted=odd)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts as they come out of encoding and decoding; an empty text for a null one."""
    return bpe.decode_ids(bpe.encode_documents(table(spark, d, "documents")))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "capacities"))


def p9_room(spark: SparkSession, d: str) -> DataFrame:
    return packing.room_left(p9_packed(spark, d), table(spark, d, "capacities"))


def p9_fits(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the documents that were packed, the containers that hold too much, and the texts divided without need."""
    packed, caps = p9_packed(spark, d), table(spark, d, "capacities").groupBy("capacity_id").agg(F.max("tokens").cast("bigint").alias("cap"))
    loads = packed.groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("load")).join(caps, "capacity_id")
    texts = packed.groupBy("capacity_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens")).join(caps, "capacity_id")
    over = loads.groupBy("capacity_id").agg(F.count_if(F.col("load") > F.col("cap")).alias("too_full"))
    return texts.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") > F.greatest(F.ceil(F.col("tokens") / F.col("cap")), F.lit(1))).alias("needlessly_divided")).join(over, "capacity_id")


def p10_assessed(spark: SparkSession, d: str) -> DataFrame:
    judged = repetition.assess(table(spark, d, "documents"))
    return judged.withColumns({c: F.round(c, 9) for c in ("share", "line_share", "source_rate")})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.assess(table(spark, d, "documents")).where("repetitive").select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_pieces, p2_joined, p3_found, p3_scores, p4_found, p4_ranking, p5_found, p5_neighbors, p6_found, p6_groups, p7_found, p7_counts, p7_incremental, p8_ids, p8_roundtrip, p9_packed, p9_room, p9_fits, p10_found, p10_assessed)}


_DISTINCT = """
distinct_postings AS (
  SELECT lower(trim(term)) AS term, chunk_id, max(coalesce(tf, 1)) AS tf FROM postings
  WHERE chunk_id IS NOT NULL AND nullif(trim(term), '') IS NOT NULL GROUP BY 1, 2
), term_counts AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS records FROM distinct_postings GROUP BY term
), marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.30 * (SELECT count(DISTINCT chunk_id) FROM chunks) THEN 'common' END AS mark FROM term_counts
)"""

_P4 = """
WITH latest AS (
  SELECT query_id, retriever, chunk_id, arg_max(struct_pack(s := CASE WHEN isnan(score) THEN NULL ELSE score END, r := rank), (logged_at, CASE WHEN isnan(score) THEN NULL ELSE score END, rank)) AS e
  FROM rank_evidence WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever IS NOT NULL GROUP BY ALL
), kept AS (
  SELECT query_id, retriever, chunk_id, e.s AS score, e.r AS rank FROM latest WHERE e.s IS NOT NULL OR e.r IS NOT NULL
), filled AS (
  SELECT query_id, retriever, chunk_id, coalesce(score,
    last_value(score IGNORE NULLS) OVER (PARTITION BY query_id, retriever ORDER BY rank DESC NULLS LAST, chunk_id DESC ROWS UNBOUNDED PRECEDING),
    last_value(score IGNORE NULLS) OVER (PARTITION BY query_id, retriever ORDER BY rank ASC NULLS LAST, chunk_id ROWS UNBOUNDED PRECEDING), 0.0) AS score FROM kept
), med AS (
  SELECT query_id, retriever, quantile_disc(score, 0.5) AS m FROM filled GROUP BY ALL
), away AS (
  SELECT f.*, m, abs(score - m) AS a FROM filled f JOIN med USING (query_id, retriever)
), spread AS (
  SELECT query_id, retriever, quantile_disc(a, 0.5) AS mad, avg(a) AS mean_away FROM away GROUP BY ALL
), valued AS (
  SELECT query_id, retriever, chunk_id, coalesce((score - m) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN mean_away > 0 THEN 1.2533 * mean_away END, 0) AS z,
    CASE retriever WHEN 'semantic' THEN alpha WHEN 'bm25' THEN 1 - alpha ELSE 0.1 END AS w
  FROM away JOIN spread USING (query_id, retriever)
  LEFT JOIN (SELECT query_id, least(greatest(coalesce(max(CASE WHEN isnan(alpha) THEN NULL ELSE alpha END), 0.55), 0), 1) AS alpha FROM queries GROUP BY 1) USING (query_id)
), lists AS (
  SELECT query_id, sum(w) AS total, CAST(count(*) AS BIGINT) AS retrievers FROM (SELECT DISTINCT query_id, retriever, w FROM valued) GROUP BY 1
), scored AS (
  SELECT query_id, chunk_id, any_value(retrievers) AS retrievers, round(sum(w * z), 6) AS lean,
    CASE WHEN any_value(total) > 0 THEN round(exp(sum(w * (ln(1 - 0.98 / (1 + exp(greatest(least(z, 700), -700)))) - ln(0.02))) / any_value(total) + ln(0.02)), 9) ELSE 0 END AS score
  FROM valued JOIN lists USING (query_id) GROUP BY query_id, chunk_id
), ranked AS (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lean DESC, chunk_id) AS INT) AS rank, retrievers FROM scored
)"""


# Scores of every posting by the definition: the tail as a sum of masses.
_P3 = f"""
WITH {_DISTINCT}, lengths AS (
  SELECT chunk_id, max(doc_len) AS len FROM doc_stats WHERE chunk_id IS NOT NULL GROUP BY chunk_id
), size AS (
  SELECT coalesce(sum(n * a), 0) AS n FROM (SELECT any_value(doc_count) AS n, any_value(avg_doc_len) AS a FROM bm25_stats GROUP BY index_id)
), rows AS (
  SELECT p.chunk_id, p.term, p.tf AS k, c.occurrences AS big_k, greatest(coalesce(l.len, 0), sum(p.tf) OVER (PARTITION BY p.chunk_id))::DOUBLE AS n, count(*) OVER (PARTITION BY p.chunk_id) AS m
  FROM distinct_postings p JOIN term_counts c USING (term) LEFT JOIN lengths l USING (chunk_id)
), drawn AS (
  SELECT *, greatest(round((SELECT n FROM size)), n + big_k - k) AS big_n FROM rows
), cases AS (
  SELECT DISTINCT k, big_k, n, big_n FROM drawn
), masses AS (
  SELECT k, big_k, n, big_n, lgamma(big_k + 1) - lgamma(i + 1) - lgamma(big_k - i + 1) + lgamma(big_n - big_k + 1) - lgamma(n - i + 1) - lgamma(big_n - big_k - n + i + 1) - lgamma(big_n + 1) + lgamma(n + 1) + lgamma(big_n - n + 1) AS ln_p
  FROM (SELECT *, unnest(generate_series(greatest(k, n + big_k - big_n)::BIGINT, least(n, big_k, greatest(k, n + big_k - big_n) + 400)::BIGINT)) AS i FROM cases)
), tails AS (
  SELECT k, big_k, n, big_n, greatest(-(max(ln_p) + ln(sum(exp(ln_p - top)))) / ln(10), 0) AS surprise FROM (SELECT *, max(ln_p) OVER (PARTITION BY k, big_k, n, big_n) AS top FROM masses) GROUP BY ALL
), ranked AS (
  SELECT d.*, t.surprise, m - rank() OVER (PARTITION BY chunk_id ORDER BY round(t.surprise, 11)) + 1 AS place FROM drawn d JOIN tails t USING (k, big_k, n, big_n)
), scored AS (
  SELECT chunk_id, term, k, surprise, greatest(max(surprise - log10(m / place)) OVER (PARTITION BY chunk_id ORDER BY round(surprise, 11) RANGE UNBOUNDED PRECEDING), 0) AS score FROM ranked
)"""

_P5 = """
WITH sound AS (
  SELECT chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors WHERE chunk_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), units AS (
  SELECT chunk_id, min(list_transform(v, lambda x: CAST(x / sqrt(list_inner_product(v, v)) AS FLOAT))) AS v FROM sound GROUP BY chunk_id
), wide AS (
  SELECT chunk_id, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM units
), pairs AS (
  SELECT a.chunk_id, b.chunk_id AS neighbor, list_inner_product(a.v, b.v) AS similarity FROM wide a JOIN wide b ON a.chunk_id <> b.chunk_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, neighbor) AS rank FROM pairs WHERE similarity >= 0.85
)"""

_P6 = r"""
WITH texts AS (
  SELECT chunk_id, any_value(content) AS content FROM chunks WHERE chunk_id IS NOT NULL AND regexp_matches(content, '\S') GROUP BY chunk_id
), words AS (
  SELECT chunk_id, content, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM texts
), shingles AS (
  SELECT DISTINCT chunk_id, lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS s FROM (SELECT chunk_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3)
), sizes AS (
  SELECT chunk_id, count(*) AS n FROM shingles GROUP BY chunk_id
), shared AS (
  SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL
), pairs AS (
  SELECT chunk_a, chunk_b FROM shared JOIN sizes x ON chunk_a = x.chunk_id JOIN sizes y ON chunk_b = y.chunk_id WHERE shared.n >= 0.6 * (x.n + y.n - shared.n)
  UNION ALL SELECT a.chunk_id, b.chunk_id FROM words a JOIN words b ON a.content = b.content AND a.chunk_id < b.chunk_id WHERE len(a.w) < 3
)"""

# Groups: the smallest chunk that pairs lead to, and the classes of equal sets that a chunk's own is linked to.
_P6_GROUPS = _P6.replace("WITH texts", "WITH RECURSIVE texts", 1) + """, classes AS (
  SELECT w.chunk_id, min(w.chunk_id) OVER (PARTITION BY coalesce(s.digest, w.content)) AS head FROM words w LEFT JOIN (SELECT chunk_id, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM shingles GROUP BY chunk_id) s USING (chunk_id)
), links AS (
  SELECT chunk_a AS u, chunk_b AS v FROM pairs UNION ALL SELECT chunk_b, chunk_a FROM pairs
), reached AS (
  SELECT chunk_id, chunk_id AS other FROM classes
  UNION
  SELECT r.chunk_id, l.v FROM reached r JOIN links l ON r.other = l.u
), degrees AS (
  SELECT c.head, count(DISTINCT d.head) AS n FROM links l JOIN classes c ON l.u = c.chunk_id JOIN classes d ON l.v = d.chunk_id WHERE c.head <> d.head GROUP BY c.head
)"""

_P10 = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS w FROM documents
), runs AS (
  SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS first FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM words WHERE len(w) > 3)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS repeated FROM (SELECT doc_id, i FROM runs WHERE i > first) r, (VALUES (0), (1), (2), (3)) o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'),
    lambda x: regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents
), measured AS (
  SELECT w.doc_id, w.source, CAST(len(w.w) AS BIGINT) AS words, coalesce(r.repeated, 0) AS repeated, len(l.ls) AS lines, len(l.ls) - len(list_distinct(l.ls)) AS repeated_lines
  FROM words w JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), shares AS (
  SELECT *, CASE WHEN words > 0 THEN repeated / words ELSE 0 END AS share, CASE WHEN lines > 0 THEN repeated_lines / lines ELSE 0 END AS line_share FROM measured
), ruled AS (
  SELECT *, words >= 20 AND (share >= 0.2 OR (lines >= 4 AND line_share >= 0.5)) AS fails FROM shares
), hosts AS (
  SELECT source, count(*) AS n, sum(fails::INT)::BIGINT AS f FROM ruled WHERE source IS NOT NULL GROUP BY source
), fitted AS (
  SELECT coalesce(sum(f) / sum(n), 0) AS mean, coalesce(var_pop(f / n), 0) AS variance, coalesce(avg(n), 1) AS size FROM hosts
), prior AS (
  SELECT mean, CASE WHEN variance - mean * (1 - mean) / size > 0 THEN greatest(mean * (1 - mean) / (variance - mean * (1 - mean) / size) - 1, 1) ELSE size END AS weight FROM fitted
), rates AS (
  SELECT source, (f + mean * weight) / (n + weight) AS source_rate FROM hosts, prior
), judged AS (
  SELECT doc_id, source, words, share, line_share, fails, source_rate, coalesce(source_rate >= 0.3, false) AS source_suspect FROM ruled LEFT JOIN rates USING (source)
), verdicts AS (
  SELECT *, (fails OR source_suspect) AND words >= 20 AND share >= 0.4 AS repetitive FROM judged
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_joined": "SELECT chunk_id, md5(min(content)) AS digest, true AS fits FROM chunks WHERE chunk_id IS NOT NULL AND length(content) > 1500 GROUP BY chunk_id",
        "p9_fits": "SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS needlessly_divided FROM capacities GROUP BY capacity_id",
        "p3_scores": _P3 + " SELECT chunk_id, term, k::BIGINT AS tf, round(surprise, 3) AS surprise, round(score, 3) AS score FROM scored",
        "p3_found": _P3 + " SELECT chunk_id, term FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(score, 9) DESC, round(surprise, 9) DESC, term) AS r FROM scored WHERE chunk_id IN (SELECT chunk_id FROM term_probes)) WHERE r = 1",
        "p4_found": _P4 + " SELECT query_id, chunk_id FROM ranked WHERE rank = 1 AND retrievers >= 2",
        "p4_ranking": _P4 + " SELECT query_id, chunk_id, score, rank, retrievers FROM ranked",
        "p5_neighbors": _P5 + " SELECT chunk_id, neighbor, round(similarity, 5) AS similarity, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5",
        "p5_found": _P5 + " SELECT DISTINCT least(chunk_id, neighbor) AS chunk_a, greatest(chunk_id, neighbor) AS chunk_b FROM ranked WHERE rank <= 5",
        "p6_found": _P6 + " SELECT chunk_a, chunk_b FROM pairs",
        "p6_groups": _P6_GROUPS + " SELECT c.chunk_id, min(r.other) AS group_id, coalesce(any_value(d.n), 0) AS links FROM classes c JOIN reached r USING (chunk_id) LEFT JOIN degrees d ON c.head = d.head GROUP BY c.chunk_id",
        "p7_found": f"WITH {_DISTINCT} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p7_counts": f"WITH {_DISTINCT} SELECT term, occurrences, records, mark FROM marked",
        "p7_incremental": f"WITH {_DISTINCT} SELECT term, occurrences, records FROM term_counts",
        "p10_assessed": _P10 + " SELECT doc_id, source, words, round(share, 9) AS share, round(line_share, 9) AS line_share, fails, round(source_rate, 9) AS source_rate, source_suspect, repetitive FROM verdicts",
        "p10_found": _P10 + " SELECT doc_id FROM verdicts WHERE repetitive",
        "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }

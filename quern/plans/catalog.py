"""The queries over the stages: each is one statement, written for either dialect."""

from __future__ import annotations

from collections.abc import Callable

from quern.functions import text
from quern.functions.dialect import Spark
from quern.plans.probes import ALPHAS, STRIDE, alpha_questions, symbol_questions
from quern.plans.stages import Stage, target_ranks

CATALOG: dict[str, Callable[[Spark], str]] = {}
#: Stages that take others' places, for queries that run on batches made from symbols.
INSTEAD: dict[str, dict[str, Stage]] = {}
#: Queries that read the stages before ``hybrid_hits`` only by its rows.
BY_HITS = {"hybrid_explain"}


def query(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
    CATALOG[f.__name__] = f
    return f


def plain(name: str, sql: str) -> None:
    CATALOG[name] = lambda d: sql


def probed(name: str, sql: str | Callable[[Spark], str], batch: Stage = symbol_questions) -> None:
    """A query over a batch made from the chunks' symbols."""
    CATALOG[name] = sql if callable(sql) else lambda d: sql
    INSTEAD[name] = {"asked_queries": batch}


# ---- text and index ------------------------------------------------------------------------------------------------


@query
def tokenize_documents(d: Spark) -> str:
    return f"SELECT doc_id, {d.sorted(text.tokens(d, 'text'))} AS tokens FROM documents"


@query
def chunk_lines(d: Spark) -> str:
    """Windows of 50 lines that overlap by 5; blank ones are left out."""
    lines = d.split("text", "\n")
    n = f"({d.size('lines')} - CASE WHEN {d.at('lines', '-1')} = '' THEN 1 ELSE 0 END)"
    body = d.join(d.slice("lines", "i * 45 + 1", f"least(i * 45 + 50, {n})"), "\n")
    count = f"CAST(ceil(greatest({n} - 50, 0) / 45.0) AS INT)"
    return f"""SELECT doc_id, CAST(i * 45 + 1 AS BIGINT) AS start_line, CAST(least(i * 45 + 50, {n}) AS BIGINT) AS end_line, content FROM (
      SELECT doc_id, lines, i, {body} AS content FROM (SELECT doc_id, {lines} AS lines FROM documents WHERE text IS NOT NULL) x{d.unnest(d.range("0", count), "a", "i")}) y
    WHERE {d.match("content", "[^ \t\n\r\f]")}"""


@query
def extract_symbols(d: Spark) -> str:
    """One symbol per line that declares something: the first rule that fits."""
    trim = d.replace_all("line", "^[ \t\r\f]+", "")
    bare = d.replace_all(d.replace_all("t", "^export (?:default )?", ""), "^(?:(?:public|private|protected|internal|static|final|abstract|open|override|inline|extern|virtual|async) )+", "")
    before = d.extract("b", r"^([^(]*)\(", 1)
    last = d.extract("before", r"[^ \t][ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*$", 1)
    c_like = "(last <> '' AND last NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return') AND contains(b, ')'))"
    rules = [
        ("pub async fn ", "fn"), ("pub fn ", "fn"), ("async fn ", "fn"), ("fn ", "fn"), ("async function ", "function"), ("function ", "function"), ("async def ", "def"), ("def ", "def"), ("class ", "class"),
        ("struct ", "struct"), ("pub struct ", "struct"), ("enum ", "enum"), ("pub enum ", "enum"), ("trait ", "trait"), ("pub trait ", "trait"), ("interface ", "interface"), ("impl ", "impl"), ("type ", "type"),
        ("const ", "const"), ("let ", "let"),
    ]
    early = [("typedef struct ", "struct"), ("typedef enum ", "enum")]
    macro = d.starts("t", "'#define '")
    when = lambda rs, result: " ".join(f"WHEN {d.starts('b', f"'{p}'")} THEN {result(p, k)}" for p, k in rs)
    kind = f"CASE WHEN {macro} THEN 'macro' {when(early, lambda p, k: f"'{k}'")} WHEN {c_like} THEN 'function' {when(rules, lambda p, k: f"'{k}'")} END"
    rest = f"CASE WHEN {macro} THEN substr(t, 9) {when(early, lambda p, k: f'substr(b, {len(p) + 1})')} WHEN {c_like} THEN last {when(rules, lambda p, k: f'substr(b, {len(p) + 1})')} END"
    cleaned = d.replace_all(d.replace_all("rest", "^[ \t\r\f]+", ""), "^(?:async )+", "")
    name = d.extract(d.replace_all(cleaned, "^[{]+", ""), "^([A-Za-z0-9_$]+)", 1)
    lines = f"SELECT chunk_id, start_line + place - 1 AS line_no, line FROM (SELECT chunk_id, start_line, {d.split('content', chr(10))} AS ls FROM chunk_rows WHERE content IS NOT NULL) c{d.unnest_at('ls', 'a', 'place', 'line')}"
    # Each column is settled before the next is built on it, so that the generated code stays small.
    return f"""SELECT chunk_id, line_no AS line, kind, name FROM ({lines}) l{d.settled("t", trim, "s1")}{d.settled("b", bare, "s2")}{d.settled("before", before, "s3")}{d.settled("last", last, "s4")}{d.settled("kind", kind, "s5")}{d.settled("rest", rest, "s6")}{d.settled("name", name, "s7")}
      WHERE kind IS NOT NULL AND name <> ''"""


plain("postings_build", "SELECT term, chunk_id, tf FROM postings_built")
plain("doc_stats", "SELECT chunk_id, doc_len FROM doc_lengths")
plain("term_stats", "SELECT term, df FROM term_frequencies")
plain("corpus_statistics", "SELECT n_chunks, round(avg_doc_len, 6) AS avg_doc_len FROM corpus_stats")
plain("hashing_encode", "SELECT chunk_id, i, v FROM chunk_vectors")
plain("symbol_lists", "SELECT name, chunk_id, CAST(place AS BIGINT) AS place FROM symbol_postings")


@query
def semantic_text(d: Spark) -> str:
    return f"SELECT chunk_id, {text.semantic_text(d)} AS semantic_text FROM chunk_rows"


@query
def query_classify(d: Spark) -> str:
    from quern.functions.classify import query_features

    return f"SELECT query_id, {', '.join(query_features(d, 'query_text'))} FROM query_rows"


plain("resolve_alpha", "SELECT query_id, alpha FROM query_rows")
plain("candidate_pool", "SELECT query_id, pool FROM query_rows")

# ---- retrieval -----------------------------------------------------------------------------------------------------

plain(
    "bm25_search",
    "SELECT h.query_id, CAST(h.rank AS BIGINT) AS rank, h.chunk_id, h.score, concat(c.file_path, ':', c.start_line, '-', c.end_line) AS location "
    "FROM bm25_hits h JOIN query_rows q ON h.query_id = q.query_id JOIN chunk_keys c ON h.chunk_id = c.chunk_id WHERE h.rank <= q.top_k",
)
_FILTERED = "SELECT h.query_id, h.chunk_id, h.score, CAST(h.rank AS BIGINT) AS rank, c.language, c.file_path FROM {} h JOIN query_rows q ON h.query_id = q.query_id JOIN chunk_keys c ON h.chunk_id = c.chunk_id WHERE h.rank <= q.top_k AND (q.filter_languages IS NOT NULL OR q.filter_paths IS NOT NULL)"
probed("bm25_filtered", _FILTERED.format("bm25_hits"))
probed("dense_filtered", _FILTERED.format("dense_hits"))
probed("filtered_search", _FILTERED.format("hybrid_hits"))
plain("dense_search", "SELECT h.query_id, h.chunk_id, h.score, CAST(h.rank AS BIGINT) AS rank FROM dense_hits h JOIN query_rows q ON h.query_id = q.query_id WHERE h.rank <= q.top_k")
plain("rrf_fuse", "SELECT query_id, chunk_id, round(CAST(sum(part) AS DOUBLE), 9) AS score FROM rrf_parts GROUP BY query_id, chunk_id")
plain("retriever_agreement", "SELECT query_id, chunk_id, round(CAST(part AS DOUBLE), 9) AS part FROM agreement")
probed("symbol_candidates", "SELECT query_id, chunk_id, round(CAST(part AS DOUBLE), 9) AS part FROM symbol_candidates")
plain("file_card_candidates", "SELECT query_id, chunk_id, overlap, round(CAST(part AS DOUBLE), 9) AS part FROM file_card_candidates")
plain("hybrid_union", "SELECT query_id, chunk_id, score FROM fused")
plain("file_coherence", "SELECT query_id, chunk_id, score, m FROM coherent")
probed("definition_boost", "SELECT query_id, chunk_id, CAST(tier AS DOUBLE) AS tier FROM definition_tiers")
plain("stem_boost", "SELECT query_id, file_path, round(share, 9) AS share, CAST(public AS DOUBLE) AS public FROM stem_boosts")
plain("path_intent_boost", "SELECT query_id, chunk_id, score FROM path_boosted")
plain("path_penalty", "SELECT query_id, chunk_id, boosted, round(penalty, 9) AS penalty, score FROM penalised")
probed("hybrid_symbols", "SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, file_path, score FROM hybrid_hits")
plain("hybrid_search", "SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, file_path, score FROM hybrid_hits")
plain(
    "hybrid_explain",
    "SELECT h.query_id, CAST(h.rank AS BIGINT) AS rank, h.chunk_id, q.alpha, CAST(b.rank AS BIGINT) AS bm25_rank, b.score AS bm25_score, CAST(s.rank AS BIGINT) AS semantic_rank, s.score AS semantic_score, f.score AS rrf_score, "
    "p.boosted AS boosted_score, h.score AS final_score FROM hybrid_hits h JOIN query_rows q ON h.query_id = q.query_id JOIN penalised p ON h.query_id = p.query_id AND h.chunk_id = p.chunk_id "
    "LEFT JOIN fused f ON h.query_id = f.query_id AND h.chunk_id = f.chunk_id LEFT JOIN bm25_hits b ON h.query_id = b.query_id AND h.chunk_id = b.chunk_id LEFT JOIN dense_hits s ON h.query_id = s.query_id AND h.chunk_id = s.chunk_id",
)

# ---- lookups -------------------------------------------------------------------------------------------------------


@query
def resolve_chunk(d: Spark) -> str:
    """The chunk that holds a file's line, for the last line of every chunk; lines meet chunks by stretches of 64 lines."""
    stretches = d.unnest(d.range("CAST(floor(start_line / 64) AS INT)", "CAST(floor(greatest(start_line, end_line) / 64) AS INT)"), "a", "stretch")
    return f"""SELECT probe_id, line, chunk_id FROM (SELECT p.chunk_id AS probe_id, p.end_line AS line, c.chunk_id, row_number() OVER (PARTITION BY p.chunk_id ORDER BY CASE WHEN p.end_line < c.end_line THEN 0 ELSE 1 END, c.chunk_id) AS n
    FROM (SELECT *, CAST(floor(end_line / 64) AS INT) AS stretch FROM chunk_keys) p JOIN (SELECT * FROM chunk_keys c{stretches}) c ON p.file_path = c.file_path AND p.stretch = c.stretch AND p.end_line >= c.start_line AND p.end_line <= c.end_line) x WHERE n = 1"""


def _neighbours(d: Spark, chunks: str = "chunk_keys") -> str:
    side = lambda name: f"SELECT c.chunk_id, o.neighbor_id, '{name}' AS side, CAST(o.place AS BIGINT) AS place FROM (SELECT k.chunk_id, s.{name} AS os FROM {chunks} k JOIN file_starts s ON k.file_path = s.file_path AND k.start_line = s.start_line) c{d.unnest_at('os', 'o', 'place', 'neighbor_id')}".replace("o.neighbor_id", "neighbor_id").replace("o.place", "place")
    return f"{side('before')} UNION ALL {side('after')}"


@query
def adjacent_chunks(d: Spark) -> str:
    return f"SELECT chunk_id, neighbor_id, side, place FROM ({_neighbours(d)}) n"


_HEADERS = "SELECT c.chunk_id, h.header_id FROM chunk_keys c JOIN (SELECT file_path, min(chunk_id) AS header_id FROM chunk_keys WHERE start_line = 1 GROUP BY file_path) h ON c.file_path = h.file_path WHERE c.start_line <> 1"
plain("file_header", _HEADERS)


def _definitions(d: Spark) -> str:
    words = d.filter(d.split("query_text", "[^A-Za-z0-9_$]+"), "w", "length(w) >= 3")
    kinds = "('class', 'const', 'def', 'enum', 'fn', 'function', 'impl', 'interface', 'struct', 'trait', 'type')"
    return f"SELECT DISTINCT q.query_id, s.chunk_id FROM (SELECT query_id, w FROM query_rows x{d.unnest(words, 'a', 'w')}) q JOIN symbol_rows s ON lower(q.w) = lower(s.name) WHERE s.kind IN {kinds}"


probed("query_symbol_definitions", _definitions)


@query
def chunks_for_file(d: Spark) -> str:
    return f"SELECT file_path, {d.ordered_list('chunk_id', 'chunk_id')} AS chunk_ids FROM chunk_keys GROUP BY file_path"


@query
def context_lines(d: Spark) -> str:
    """The lines of each best hit with three lines of its file before and after, as far as chunks hold them."""
    hits = "SELECT h.query_id, c.chunk_id, c.file_path, c.start_line, c.end_line FROM bm25_hits h JOIN chunk_keys c ON h.chunk_id = c.chunk_id WHERE h.rank = 1"
    near = f"SELECT r.file_path, r.start_line, r.content FROM chunk_rows r JOIN (SELECT DISTINCT file_path FROM ({hits}) h) f ON r.file_path = f.file_path"
    lines = f"SELECT file_path, start_line + place - 1 AS line_no, min(line) AS line FROM (SELECT file_path, start_line, {d.split('content', chr(10))} AS ls FROM ({near}) r) c{d.unnest_at('ls', 'a', 'place', 'line')} GROUP BY file_path, start_line + place - 1"
    return f"SELECT h.query_id, h.chunk_id, min(l.line_no) AS first_line, max(l.line_no) AS last_line, {d.join(d.ordered_list('l.line', 'l.line_no'), chr(10))} AS context FROM ({hits}) h JOIN ({lines}) l ON h.file_path = l.file_path AND l.line_no BETWEEN h.start_line - 3 AND h.end_line + 3 GROUP BY h.query_id, h.chunk_id"


def pack(d: Spark, tokens: int = 6000) -> str:
    """What fits in so many tokens of four bytes per query: each hit of a new file, its header, neighbours and the definitions it names."""
    budget = 4 * tokens
    firsts = "SELECT query_id, chunk_id, rank, file_path, start_line FROM (SELECT h.query_id, h.chunk_id, h.rank, h.file_path, c.start_line, row_number() OVER (PARTITION BY h.query_id, h.file_path ORDER BY h.rank) AS n FROM hybrid_hits h JOIN chunk_keys c ON h.chunk_id = c.chunk_id) x WHERE n = 1"
    around = _neighbours(d, f"(SELECT DISTINCT chunk_id, file_path, start_line FROM ({firsts}) z)")
    items = f"""SELECT query_id, chunk_id, rank, 0 AS kind_no, 'primary' AS kind, CAST(0 AS BIGINT) AS k FROM ({firsts}) f
      UNION ALL SELECT f.query_id, h.header_id, f.rank, 1, 'file_header', CAST(0 AS BIGINT) FROM ({firsts}) f JOIN (SELECT file_path, min(chunk_id) AS header_id FROM chunk_keys WHERE start_line = 1 GROUP BY file_path) h ON f.file_path = h.file_path WHERE f.start_line <> 1
      UNION ALL SELECT f.query_id, n.neighbor_id, f.rank, CASE WHEN n.side = 'before' THEN 2 ELSE 3 END, 'neighbor', n.place FROM ({firsts}) f JOIN ({around}) n ON f.chunk_id = n.chunk_id
      UNION ALL SELECT f.query_id, s.chunk_id, f.rank, 4, 'symbol_definition', s.chunk_id FROM ({firsts}) f JOIN ({_definitions(d)}) s ON f.query_id = s.query_id"""
    size = d.bytes("content")
    return f"""SELECT query_id, chunk_id, kind, CAST(place AS BIGINT) AS place, least(size, {budget} - before) AS taken, CASE WHEN size > {budget} - before THEN substr(content, 1, CAST({budget} - before AS INT)) ELSE content END AS content FROM (
      SELECT query_id, chunk_id, kind, place, size, content, coalesce(sum(size) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT i.query_id, i.chunk_id, i.kind, {size} AS size, c.content, row_number() OVER (PARTITION BY i.query_id ORDER BY i.rank, i.kind_no, i.k, i.chunk_id) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, kind_no, k) AS n FROM ({items}) u) i JOIN chunk_rows c ON i.chunk_id = c.chunk_id WHERE i.n = 1) x) y WHERE before < {budget}"""


@query
def pack_budget(d: Spark) -> str:
    return pack(d)


plain("list_files", "SELECT file_path, CAST(place AS BIGINT) AS place, CAST(total AS BIGINT) AS total, total > 200 AS truncated FROM (SELECT file_path, row_number() OVER (ORDER BY file_path) AS place, t.total FROM (SELECT DISTINCT file_path FROM chunk_keys) f, (SELECT count(DISTINCT file_path) AS total FROM chunk_keys) t) x WHERE place <= 200")
plain("index_stats", "SELECT language, count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunk_keys WHERE language IS NOT NULL GROUP BY language")


def warnings(d: Spark) -> str:
    """Filters that match nothing: ``(query_id, kind, wanted, suggestion)``; a path may match without its ``./``."""
    raw = "SELECT query_id, filter_languages, filter_paths FROM asked_queries"
    bare = d.replace_all("w.wanted", "^[.]/", "")
    return f"""SELECT w.query_id, 'language' AS kind, w.wanted, CAST(NULL AS {d.string()}) AS suggestion FROM (SELECT query_id, wanted FROM ({raw}) q{d.unnest("filter_languages", "a", "wanted")}) w LEFT JOIN (SELECT DISTINCT language FROM chunk_keys) c ON w.wanted = c.language WHERE c.language IS NULL
    UNION ALL SELECT w.query_id, 'path', w.wanted, s.file_path FROM (SELECT query_id, wanted FROM ({raw}) q{d.unnest("filter_paths", "a", "wanted")}) w LEFT JOIN (SELECT DISTINCT file_path FROM chunk_keys) c ON w.wanted = c.file_path LEFT JOIN (SELECT DISTINCT file_path FROM chunk_keys) s ON {bare} = s.file_path WHERE c.file_path IS NULL"""


probed("filter_warnings", warnings)


plain(
    "signature_diff",
    "SELECT coalesce(c.file_path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'removed' WHEN s.first_len IS NULL OR s.last_len IS NULL OR s.first_len <> s.last_len OR s.first_seen <> s.last_seen THEN 'changed' ELSE 'same' END AS status "
    "FROM (SELECT DISTINCT file_path FROM chunk_keys) c FULL OUTER JOIN (SELECT path, min(modified_ns) AS first_seen, max(modified_ns) AS last_seen, min(len) AS first_len, max(len) AS last_len FROM signatures WHERE path IS NOT NULL GROUP BY path) s ON c.file_path = s.path",
)

# ---- evaluation ----------------------------------------------------------------------------------------------------
# Cases are queries for the chunks' symbols; what they should find is where the symbols are declared.

_IDEAL = "(SELECT n, sum(1 / log2(m + 1)) AS ideal FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) a(n), (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) b(m) WHERE m <= n GROUP BY n)"


def ndcg(ranks: str, k: int = 10) -> str:
    """``(query_id, ndcg)`` from one row per relevant target; targets of one rank fill one place."""
    places = f"SELECT DISTINCT query_id, rank FROM ({ranks}) r WHERE rank <= {k}"
    gains = f"SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM ({places}) p GROUP BY query_id"
    return f"SELECT n.query_id, round(coalesce(g.dcg, 0) / i.ideal, 9) AS ndcg FROM (SELECT query_id, CAST(least(count(*), {k}) AS INT) AS n FROM ({ranks}) r GROUP BY query_id) n JOIN {_IDEAL} i ON n.n = i.n LEFT JOIN ({gains}) g ON n.query_id = g.query_id"


def _scores(first: str, by: str = "") -> str:
    """Of the first rank per case: cases, hits, mean reciprocal rank and mean discounted gain, by the columns named."""
    return (
        f"SELECT {by}count(*) AS cases, CAST(sum(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN first IS NOT NULL THEN CAST(1 AS DOUBLE) / first ELSE CAST(0 AS DOUBLE) END), 6) AS mrr, "
        f"round(avg(CASE WHEN first IS NOT NULL THEN 1 / log2(first + 1) ELSE CAST(0 AS DOUBLE) END), 6) AS ndcg FROM ({first}) x" + (f" GROUP BY {by.rstrip(', ')}" if by else "")
    )


_FIRST = "SELECT query_id, min(CASE WHEN rank <= 10 THEN rank END) AS first FROM {} GROUP BY query_id"

probed("target_ranks", "SELECT query_id, path, first_line, CAST(rank AS BIGINT) AS rank FROM final_ranks")
probed("ndcg_at_k", f"SELECT a.query_id, a.ndcg AS ndcg5, b.ndcg AS ndcg10 FROM ({ndcg('SELECT query_id, rank FROM final_ranks', 5)}) a JOIN ({ndcg('SELECT query_id, rank FROM final_ranks')}) b ON a.query_id = b.query_id")
probed("eval_hit_mrr_ndcg", _scores(_FIRST.format("final_ranks")))
probed(
    "method_comparison",
    f"SELECT method, cases, hits, mrr, ndcg, CAST(row_number() OVER (ORDER BY ndcg DESC, method) AS BIGINT) AS place FROM (SELECT 'hybrid' AS method, * FROM ({_scores(_FIRST.format('final_ranks'))}) a "
    f"UNION ALL SELECT 'bm25', * FROM ({_scores(_FIRST.format('bm25_ranks'))}) b UNION ALL SELECT 'semantic', * FROM ({_scores(_FIRST.format('semantic_ranks'))}) c) m",
)


def tune_alpha(d: Spark) -> str:
    """The three modes and hybrid with four alphas on the same cases; the best is the last of the highest gain."""
    n = len(ALPHAS)
    hybrid, bm25, semantic = (target_ranks(d, h, STRIDE * n) for h in ("hybrid_hits", "bm25_hits", "dense_hits"))
    first = lambda ranks: f"SELECT query_id, min(CASE WHEN rank <= 10 THEN rank END) AS first FROM ({ranks}) r GROUP BY query_id"
    # Without an alpha of its own a batch's first queries stand for the engine's choice.
    places = f"""SELECT 0 AS candidate, first FROM ({first(bm25)}) b WHERE query_id % {n} = 0 UNION ALL SELECT 1, first FROM ({first(semantic)}) s WHERE query_id % {n} = 0
      UNION ALL SELECT 2 + CAST(query_id % {n} AS INT), first FROM ({first(hybrid)}) h"""
    modes = " ".join(f"WHEN {2 + i} THEN CAST({a} AS DOUBLE)" for i, a in enumerate(ALPHAS))
    return f"""SELECT candidate, CASE candidate WHEN 0 THEN 'bm25' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS mode, CASE candidate {modes} END AS alpha, cases, hits, mrr, ndcg, row_number() OVER (ORDER BY ndcg DESC, candidate DESC) = 1 AS best FROM ({_scores(places, "candidate, ")}) c"""


probed("tune_alpha", tune_alpha, alpha_questions)


@query
def latency_percentile(d: Spark) -> str:
    """The value at place floor(n p) of each sorted sample; not interpolated."""
    return """SELECT event_type, count(*) AS n, max(CASE WHEN place = least(n_all - 1, CAST(floor(n_all * 0.5) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN place = least(n_all - 1, CAST(floor(n_all * 0.9) AS BIGINT)) THEN value END) AS p90 FROM (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n_all FROM events WHERE value IS NOT NULL) x GROUP BY event_type"""



@query
def weighted_rollup(d: Spark) -> str:
    """Per repository the mean gain of its tasks, and over all repositories and per category the mean weighted by tasks."""
    ranks = f"SELECT query_id * 1000 + dense_rank() OVER (ORDER BY {d.at(d.split('path', '/'), '1')}) AS query_id, {d.at(d.split('path', '/'), '1')} AS repo, rank, query_id AS asked FROM final_ranks"
    tasks = f"SELECT n.ndcg, r.repo, q.category FROM ({ndcg(f'SELECT query_id, rank FROM ({ranks}) x')}) n JOIN (SELECT DISTINCT query_id, repo, asked FROM ({ranks}) y) r ON n.query_id = r.query_id JOIN query_rows q ON r.asked = q.query_id"
    repos = f"SELECT repo, category, count(*) AS tasks, avg(ndcg) AS mean FROM ({tasks}) t GROUP BY repo, category"
    return f"""SELECT repo, category, tasks, round(mean, 6) AS mean FROM ({repos}) r UNION ALL SELECT 'all', category, CAST(sum(tasks) AS BIGINT), round(sum(mean * tasks) / sum(tasks), 6) FROM ({repos}) r GROUP BY category
      UNION ALL SELECT 'all', 'all', CAST(sum(tasks) AS BIGINT), round(sum(mean * tasks) / sum(tasks), 6) FROM ({repos}) r"""


INSTEAD["weighted_rollup"] = {"asked_queries": symbol_questions}
_DIAGNOSED = (
    "SELECT f.query_id, f.path, f.first_line, CAST(f.rank AS BIGINT) AS final_rank, CAST(b.rank AS BIGINT) AS bm25_rank, CAST(s.rank AS BIGINT) AS semantic_rank, b.rank IS NOT NULL OR s.rank IS NOT NULL AS in_union, "
    "CASE WHEN f.rank <= 10 THEN 'top10' WHEN f.rank IS NOT NULL THEN 'reranking' WHEN b.rank IS NOT NULL OR s.rank IS NOT NULL THEN 'reranking_or_depth' ELSE 'candidate_generation' END AS stage "
    "FROM final_ranks f LEFT JOIN bm25_ranks b ON f.query_id = b.query_id AND f.path = b.path AND f.first_line = b.first_line LEFT JOIN semantic_ranks s ON f.query_id = s.query_id AND f.path = s.path AND f.first_line = s.first_line"
)
probed("candidate_diagnostics", _DIAGNOSED)
probed("diagnostics_summary", f"SELECT stage, count(*) AS targets FROM ({_DIAGNOSED}) d GROUP BY stage")


def context_curve(d: Spark) -> str:
    """Mean recall of the files that declare a symbol by the words that the hybrid hits down to them cost."""
    words = text.word_count(d, "c.content")
    hits = f"SELECT h.query_id, h.rank, h.file_path, sum({words}) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS cost FROM hybrid_hits h JOIN chunk_rows c ON h.chunk_id = c.chunk_id"
    relevant = "SELECT DISTINCT query_id, path AS file_path FROM final_ranks"
    found = f"SELECT h.query_id, h.file_path, min(h.cost) AS cost FROM ({hits}) h JOIN ({relevant}) r ON h.query_id = r.query_id AND h.file_path = r.file_path GROUP BY h.query_id, h.file_path"
    return f"""SELECT budget, round(avg(CAST(hit AS DOUBLE) / n), 6) AS recall FROM (
      SELECT b.budget, t.query_id, t.n, count(f.file_path) AS hit FROM (SELECT query_id, count(*) AS n FROM ({relevant}) r GROUP BY query_id) t JOIN (VALUES (0), (100), (250), (500), (1000), (2000), (4000), (8000), (16000), (32000)) b(budget) ON b.budget >= 0
      LEFT JOIN ({found}) f ON f.query_id = t.query_id AND f.cost <= b.budget GROUP BY b.budget, t.query_id, t.n) x GROUP BY budget"""


probed("context_curve", context_curve)


@query
def keyword_file_baseline(d: Spark) -> str:
    """Files by the number of a query's keywords that their lines hold, then by matching lines, at most 500 per keyword."""
    keys = f"SELECT DISTINCT query_id, lower(w) AS word FROM (SELECT query_id, w FROM query_rows q{d.unnest(d.all_matches('query_text', '[a-zA-Z][a-zA-Z0-9]*'), 'a', 'w')}) x WHERE length(w) >= 3 AND lower(w) NOT IN {text.stop_list()}"
    lines = f"SELECT file_path, lower(line) AS line FROM (SELECT file_path, {d.split('content', chr(10))} AS ls FROM chunk_rows) c{d.unnest('ls', 'a', 'line')}"
    counted = f"SELECT k.word, l.file_path, least(count(*), 500) AS matches FROM (SELECT DISTINCT word FROM ({keys}) k) k JOIN (SELECT file_path, w, line FROM (SELECT file_path, line, {d.distinct(d.split('line', '[^a-z0-9]+'))} AS ws FROM ({lines}) l) m{d.unnest('ws', 'b', 'w')}) l ON k.word = l.w GROUP BY k.word, l.file_path"
    return f"SELECT query_id, file_path, keywords, matches, CAST(row_number() OVER (PARTITION BY query_id ORDER BY keywords DESC, matches DESC, file_path) AS BIGINT) AS rank FROM (SELECT k.query_id, c.file_path, count(*) AS keywords, CAST(sum(c.matches) AS BIGINT) AS matches FROM ({keys}) k JOIN ({counted}) c ON k.word = c.word GROUP BY k.query_id, c.file_path) x"

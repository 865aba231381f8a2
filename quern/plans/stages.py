"""The retrieval engine as named relational stages.

A stage is SQL text over tables and earlier stages, written for either dialect.  A batch of queries is a table, so every
stage keys by ``query_id`` and one query is a batch of one row.  ``HEAVY`` stages are written once and read many times.
Scores are rounded before they are ranked and ties go to the smaller chunk_id, so results do not depend on the order of
summation.
"""

from __future__ import annotations

from collections.abc import Callable

from quern.functions import classify, text
from quern.functions.dialect import Spark
from quern.plans.probes import NAMES, STRIDE

Stage = Callable[[Spark], str]
STAGES: dict[str, Stage] = {}
HEAVY: set[str] = set()
#: Heavy stages of the index are stored as columns, as most readers need few of them; those of a batch of queries, which are
#: small and read whole, as rows, but for the hits, which are many.
COLUMNS = {"bm25_hits", "coherent", "chunk_rows", "postings_built", "impacts", "chunk_vectors", "symbol_rows", "file_features"}

#: Components of the hashing encoder's vectors.
DIMENSIONS = 256
#: Rank offset of reciprocal rank fusion.
RRF = 60


def stage(function: Stage | None = None, *, heavy: bool = False):
    def add(f: Stage) -> Stage:
        STAGES[f.__name__] = f
        if heavy:
            HEAVY.add(f.__name__)
        return f

    return add(function) if function else add


# ---- index ---------------------------------------------------------------------------------------------------------


@stage(heavy=True)
def chunk_rows(d: Spark) -> str:
    """One row per chunk, the latest delivery; languages in lower case."""
    return f"""SELECT chunk_id, repo, file_path, start_line, end_line, lower(language) AS language, content, symbols, coalesce(breadcrumbs, {d.no_strings()}) AS breadcrumbs
    FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, lower(language) NULLS LAST) AS n FROM chunks WHERE chunk_id IS NOT NULL AND file_path IS NOT NULL) x
    WHERE n = 1"""


@stage
def chunk_keys(d: Spark) -> str:
    return "SELECT chunk_id, repo, file_path, start_line, end_line, language FROM chunk_rows"


@stage(heavy=True)
def postings_built(d: Spark) -> str:
    """Each piece of a chunk gives its distinct tokens; the length of a chunk is the number of all."""
    tokens = f"flatten({d.map(text.indexed_pieces(d), 'piece', text.tokens(d, 'piece'))})"
    return f"""SELECT term, chunk_id, count(*) AS tf, doc_len FROM (SELECT chunk_id, toks, {d.size("toks")} AS doc_len FROM chunk_rows c{d.settled("toks", tokens, "s")}) x{d.unnest("toks", "b", "term")}
    GROUP BY term, chunk_id, doc_len"""


@stage
def doc_lengths(d: Spark) -> str:
    return "SELECT chunk_id, max(doc_len) AS doc_len FROM postings_built GROUP BY chunk_id"


@stage
def term_frequencies(d: Spark) -> str:
    return "SELECT term, count(*) AS df FROM postings_built GROUP BY term"


@stage
def corpus_stats(d: Spark) -> str:
    return """SELECT c.n AS n_chunks, CASE WHEN c.n > 0 THEN coalesce(l.total, 0) / c.n ELSE 0.0 END AS avg_doc_len
    FROM (SELECT count(*) AS n FROM chunk_rows) c, (SELECT CAST(sum(doc_len) AS DOUBLE) AS total FROM doc_lengths) l"""


@stage(heavy=True)
def impacts(d: Spark) -> str:
    """Each posting with what it adds to a BM25 score; what a query needs of the corpus is folded in once."""
    return """SELECT /*+ SHUFFLE_HASH(f) */ p.term, p.chunk_id,
      ln((s.n_chunks - f.df + 0.5) / (f.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.doc_len / greatest(s.avg_doc_len, 1.0))) AS weight
    FROM postings_built p JOIN term_frequencies f ON p.term = f.term, corpus_stats s"""


@stage(heavy=True)
def chunk_vectors(d: Spark) -> str:
    """Signed counts of hashed tokens; zero components are left out."""
    hashed = f"SELECT chunk_id, md5(t) AS h FROM (SELECT chunk_id, {text.semantic_text(d)} AS s FROM chunk_rows) c{d.unnest(text.tokens(d, 's'), 'a', 't')}"
    return _hashed("chunk_id", hashed, d)


def _hashed(key: str, rows: str, d: Spark) -> str:
    place = f"{d.hex_number('substr(h, 1, 8)')} % {DIMENSIONS}"
    sign = "CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END"
    return f"SELECT {key}, i, v FROM (SELECT {key}, {place} AS i, CAST(sum({sign}) AS BIGINT) AS v FROM ({rows}) x GROUP BY {key}, {place}) y WHERE v <> 0"


@stage
def chunk_norms(d: Spark) -> str:
    return "SELECT chunk_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM chunk_vectors GROUP BY chunk_id"


@stage(heavy=True)
def symbol_rows(d: Spark) -> str:
    return f"SELECT chunk_id, file_path, language, s.name AS name, s.kind AS kind, s.line AS line FROM (SELECT * FROM chunk_rows WHERE symbols IS NOT NULL) c{d.unnest('symbols', 'a', 's')}"


@stage
def symbol_postings(d: Spark) -> str:
    """Chunks by lower-cased symbol, with the place of the chunk in the symbol's list."""
    return "SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY chunk_id) - 1 AS place FROM (SELECT DISTINCT lower(name) AS name, chunk_id FROM symbol_rows WHERE name IS NOT NULL) x"


@stage(heavy=True)
def probe_names(d: Spark) -> str:
    """The most widespread symbols with the first file that declares them, for queries made from the chunks (``probes``)."""
    return f"""SELECT name, path, place FROM (SELECT name, path, CAST(row_number() OVER (ORDER BY n DESC, name) AS BIGINT) AS place FROM (
      SELECT name, count(DISTINCT chunk_id) AS n, min(file_path) AS path FROM symbol_rows WHERE name IS NOT NULL GROUP BY name) x) y WHERE place <= {NAMES}"""


@stage
def targets(d: Spark) -> str:
    """Where each such name is declared: what a query for it should find."""
    return "SELECT DISTINCT p.place, s.file_path AS path, s.line AS first_line, s.line AS last_line FROM probe_names p JOIN symbol_rows s ON p.name = s.name WHERE s.line IS NOT NULL"


@stage(heavy=True)
def file_features(d: Spark) -> str:
    """Per file: its stems, path terms and classes."""
    flags = ", ".join(f"{v} AS {k}" for k, v in classify.path_flags(d, "file_path").items())
    stem = f"lower({text.stem(d, 'file_path')})"
    parent = f"lower({text.parent_name(d, 'file_path')})"
    parts = d.cat(text.identifier_parts(d, stem), f"CASE WHEN {parent} IN ('', '.', '..') THEN {d.no_strings()} ELSE {text.identifier_parts(d, parent)} END")
    return f"""SELECT file_path, {stem} AS stem, {text.path_terms(d, "replace(file_path, " + d.lit(chr(92)) + ", '/')")} AS path_terms, {parts} AS stem_parts, {text.identifier_parts(d, stem)} AS own_parts,
      {stem} IN {classify.PUBLIC_STEMS} AS is_public, {flags} FROM (SELECT DISTINCT file_path FROM chunk_rows) f"""


@stage
def file_terms(d: Spark) -> str:
    """The terms a file is known by, those of its path marked."""
    of = lambda x: f"SELECT file_path, t AS term, 0 AS in_path FROM (SELECT DISTINCT file_path, {x} AS s FROM {{}}) x{d.unnest(text.tokens(d, 's'), 'a', 't')}"
    crumbs = f"SELECT file_path, t AS term, 0 AS in_path FROM (SELECT DISTINCT file_path, s FROM (SELECT file_path, breadcrumbs FROM chunk_rows) c{d.unnest('breadcrumbs', 'a', 's')}) x{d.unnest(text.tokens(d, 's'), 'b', 't')}"
    return f"""SELECT file_path, term, max(in_path) AS in_path FROM (
      SELECT file_path, t AS term, 1 AS in_path FROM file_features f{d.unnest(text.tokens(d, "file_path"), "a", "t")}
      UNION ALL {of("language").format("chunk_rows")} UNION ALL {of("name").format("symbol_rows")} UNION ALL {of("kind").format("symbol_rows")} UNION ALL {crumbs}) x GROUP BY file_path, term"""


@stage
def file_starts(d: Spark) -> str:
    """The lines of a file at which chunks start, with the first two chunks there and what stands before and after."""
    both = lambda near, far: d.slice(d.cat(f"coalesce({near}, {d.no_numbers()})", f"coalesce({far}, {d.no_numbers()})"), "1", "2")
    firsts = d.slice(d.ordered_list("chunk_id", "chunk_id"), "1", "2")
    over = "OVER (PARTITION BY file_path ORDER BY start_line)"
    return f"""SELECT file_path, start_line, {both("p1", "p2")} AS before, {both("n1", "n2")} AS after FROM (
      SELECT file_path, start_line, lag(ids) {over} AS p1, lag(ids, 2) {over} AS p2, lead(ids) {over} AS n1, lead(ids, 2) {over} AS n2 FROM (
        SELECT file_path, start_line, {firsts} AS ids FROM chunk_keys WHERE start_line IS NOT NULL GROUP BY file_path, start_line) x) y"""


# ---- queries -------------------------------------------------------------------------------------------------------


@stage
def asked_queries(d: Spark) -> str:
    """The batch as it was logged; a batch of another origin takes this stage's place."""
    return f"SELECT query_id, query_text, search_mode, top_k, alpha, filter_languages, {d.null_strings()} AS filter_paths, issued_at FROM queries"


@stage(heavy=True)
def query_rows(d: Spark) -> str:
    features = ", ".join(f"{v} AS {k}" for k, v in classify.query_features(d, "query_text").items())
    return f"""SELECT *, {classify.resolved_alpha("own_alpha")} AS alpha, CAST({classify.pool_size("top_k")} AS BIGINT) AS pool FROM (
      SELECT query_id, query_text, coalesce(top_k, 5) AS top_k, alpha AS own_alpha, filter_languages, {d.map("filter_paths", "p", text.normalized_path(d, "p"))} AS filter_paths, {features}
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY issued_at) AS n FROM asked_queries WHERE query_id IS NOT NULL) q WHERE n = 1) x"""


@stage(heavy=True)
def query_terms(d: Spark) -> str:
    return f"SELECT query_id, term FROM query_rows q{d.unnest(text.tokens(d, 'query_text'), 'a', 'term')}"


@stage
def query_vectors(d: Spark) -> str:
    return _hashed("query_id", "SELECT query_id, md5(term) AS h FROM query_terms", d)


@stage
def query_norms(d: Spark) -> str:
    return "SELECT query_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM query_vectors GROUP BY query_id"


@stage
def query_path_terms(d: Spark) -> str:
    return f"SELECT query_id, term FROM query_rows q{d.unnest(text.query_path_terms(d, 'query_text'), 'a', 'term')}"


def _allowed(d: Spark, c: str) -> str:
    """Whether the query ``q`` takes chunks like those of ``c``: any of its languages, and any of its paths."""
    one_of = lambda wanted, value: f"(q.{wanted} IS NULL OR {d.size(f'q.{wanted}')} = 0 OR {d.has(f'q.{wanted}', value)})"
    return f"({one_of('filter_languages', f'{c}.language')} AND {one_of('filter_paths', f'{c}.file_path')})"


# ---- retrievers ----------------------------------------------------------------------------------------------------


@stage(heavy=True)
def bm25_hits(d: Spark) -> str:
    """The chunks that hold a query term and pass the query's filter, ranked as far as the query's pool goes."""
    return f"""SELECT query_id, chunk_id, score, rank FROM (
      SELECT query_id, chunk_id, score, pool, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT x.query_id, x.chunk_id, q.pool, x.score FROM (SELECT t.query_id, i.chunk_id, round(sum(i.weight), 6) AS score FROM query_terms t JOIN impacts i ON t.term = i.term GROUP BY t.query_id, i.chunk_id) x
        JOIN query_rows q ON x.query_id = q.query_id JOIN chunk_keys c ON x.chunk_id = c.chunk_id WHERE x.score > 0 AND {_allowed(d, "c")}) y) z WHERE {d.within("rank", "pool")}"""


@stage(heavy=True)
def dense_hits(d: Spark) -> str:
    """Chunks by cosine of their hashed vectors, ranked, as far as a hybrid query's pool goes.  On Spark a block product takes its place."""
    return f"""SELECT query_id, chunk_id, score, rank FROM (
      SELECT query_id, chunk_id, score, pool, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT q.query_id, c.chunk_id, q.pool, round(coalesce(p.dot, 0) / (qn.norm * n.norm), 6) AS score
        FROM query_rows q JOIN query_norms qn ON q.query_id = qn.query_id JOIN chunk_keys c ON {_allowed(d, "c")} JOIN chunk_norms n ON c.chunk_id = n.chunk_id
        LEFT JOIN (SELECT a.query_id, b.chunk_id, CAST(sum(a.v * b.v) AS DOUBLE) AS dot FROM query_vectors a JOIN chunk_vectors b ON a.i = b.i GROUP BY a.query_id, b.chunk_id) p
          ON p.query_id = q.query_id AND p.chunk_id = c.chunk_id) x) y WHERE rank <= pool"""


@stage
def symbol_candidates(d: Spark) -> str:
    """Chunks with a symbol that the query names; the first 64 per query in the order of term and place."""
    return f"""SELECT query_id, chunk_id, sum(part) AS part FROM (
      SELECT query_id, chunk_id, 1.0 / ({RRF + 1} + place) AS part, row_number() OVER (PARTITION BY query_id ORDER BY term, place) AS n FROM (
        SELECT q.query_id, q.term, s.chunk_id, s.place FROM (SELECT * FROM query_rows q{d.unnest(text.symbol_terms(d, "query_text"), "a", "term")} WHERE is_symbol OR has_camel_word) q
        JOIN symbol_postings s ON q.term = s.name JOIN chunk_keys c ON s.chunk_id = c.chunk_id WHERE {_allowed(d, "c")}) x) y
    WHERE n <= 64 GROUP BY query_id, chunk_id"""


@stage
def file_card_candidates(d: Spark) -> str:
    """The first chunk of the 32 files whose cards share most terms with the query, one of them in the path."""
    return f"""SELECT query_id, chunk_id, 0.5 * overlap / ({RRF} + n) AS part, overlap FROM (
      SELECT query_id, chunk_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, file_path) AS n FROM (
        SELECT o.query_id, o.file_path, o.overlap, min(f.chunk_id) AS chunk_id FROM (
          SELECT t.query_id, f.file_path, count(*) AS overlap FROM query_terms t JOIN query_rows q ON t.query_id = q.query_id JOIN file_terms f ON t.term = f.term, corpus_stats s
          WHERE length(t.term) >= 3 AND (q.is_file_card OR (q.is_broad AND s.n_chunks <= 1500)) GROUP BY t.query_id, f.file_path HAVING max(f.in_path) = 1) o
        JOIN query_rows q ON o.query_id = q.query_id JOIN chunk_keys f ON o.file_path = f.file_path AND {_allowed(d, "f")} GROUP BY o.query_id, o.file_path, o.overlap) x) y WHERE n <= 32"""


# ---- fusion --------------------------------------------------------------------------------------------------------


@stage
def rrf_parts(d: Spark) -> str:
    return f"""SELECT h.query_id, h.chunk_id, q.alpha / ({RRF} + h.rank) AS part FROM dense_hits h JOIN query_rows q ON h.query_id = q.query_id
    UNION ALL SELECT h.query_id, h.chunk_id, (1 - q.alpha) / ({RRF} + h.rank) AS part FROM bm25_hits h JOIN query_rows q ON h.query_id = q.query_id"""


#: The chunks that both retrievers name.
BOTH_NAME = "dense_hits s JOIN bm25_hits m ON s.query_id = m.query_id AND s.chunk_id = m.chunk_id"


@stage
def agreement(d: Spark) -> str:
    """What two retrievers add by naming the same chunk among their first fifty."""
    return f"""SELECT query_id, chunk_id, 0.35 / ({RRF + 1} + b) * bal + CASE WHEN w < 5 THEN 1.5 / ({RRF + 1} + b) * bal ELSE 0 END AS part FROM (
      SELECT s.query_id, s.chunk_id, least(s.rank, m.rank) - 1 AS b, greatest(s.rank, m.rank) - 1 AS w, 1 / (1 + (greatest(s.rank, m.rank) - least(s.rank, m.rank)) / 25.0) AS bal
      FROM {BOTH_NAME} WHERE s.rank <= 50 AND m.rank <= 50) x"""


@stage(heavy=True)
def fused(d: Spark) -> str:
    return """SELECT query_id, chunk_id, round(CAST(sum(part) AS DOUBLE), 9) AS score FROM (
      SELECT query_id, chunk_id, CAST(part AS DOUBLE) AS part FROM rrf_parts UNION ALL SELECT query_id, chunk_id, CAST(part AS DOUBLE) FROM agreement
      UNION ALL SELECT query_id, chunk_id, CAST(part AS DOUBLE) FROM symbol_candidates UNION ALL SELECT query_id, chunk_id, CAST(part AS DOUBLE) FROM file_card_candidates) x GROUP BY query_id, chunk_id"""


@stage(heavy=True)
def coherent(d: Spark) -> str:
    """The best chunk of a file gains by what the whole file scores; ``m`` is the query's best score from here on."""
    return """SELECT query_id, chunk_id, file_path, score, max(score) OVER (PARTITION BY query_id) AS m FROM (
      SELECT query_id, chunk_id, file_path, round(score + CASE WHEN n = 1 AND best > 0 THEN 0.2 * best * file_sum / max(file_sum) OVER (PARTITION BY query_id) ELSE 0 END, 9) AS score FROM (
        SELECT f.query_id, f.chunk_id, c.file_path, f.score, greatest(max(f.score) OVER (PARTITION BY f.query_id), 0) AS best, round(sum(f.score) OVER (PARTITION BY f.query_id, c.file_path), 9) AS file_sum,
          row_number() OVER (PARTITION BY f.query_id, c.file_path ORDER BY f.score DESC, f.chunk_id) AS n
        FROM fused f JOIN chunk_keys c ON f.chunk_id = c.chunk_id) x) y"""


# ---- boosts --------------------------------------------------------------------------------------------------------

# Words that introduce a definition.
DEFINERS = (
    "class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object", "abstract class", "data class", "fn", "fun", "package", "namespace",
    "protocol", "record", "typedef",
)
SQL_DEFINERS = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")


def _definition(d: Spark, words: tuple[str, ...], ignore_case: bool, name: str) -> str:
    flags = ("(?d" if d.name == "spark" else "(?") + ("i" if ignore_case else "") + "m)"
    before = flags + r"(?:^|\s)(?:" + "|".join(words) + r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*\$?"
    return f"concat({d.lit(before)}, {d.quoted(name)}, {d.lit(r'(?:\s|[<({:\[;]|$)')})"


@stage
def query_names(d: Spark) -> str:
    """The symbols a query asks to be defined, and what a definition is worth in units of the best score."""
    q = "query_text"
    leaf = f"CASE WHEN contains({q}, '::') THEN {d.at(d.split(q, '::'), '-1')} WHEN contains({q}, {d.lit(chr(92))}) THEN {d.at(d.split(q, chr(92) * 2), '-1')} WHEN contains({q}, '->') THEN {d.at(d.split(q, '->'), '-1')} WHEN contains({q}, '.') THEN {d.at(d.split(q, '[.]'), '-1')} ELSE {text.trimmed(d, q)} END"
    camel = d.filter(d.split(q, "[^A-Za-z0-9_]+"), "w", d.match("w", "^(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)$"))
    dotted = d.filter(d.split(q, "[^A-Za-z0-9_.]+"), "w", d.match("w", r"(?:^|\.)[a-z_][A-Za-z0-9_]*\.[a-z_][A-Za-z0-9_]*$"))
    leaves = d.map(dotted, "w", d.at(d.split("w", "[.]"), "-1"))
    embedded = f"SELECT DISTINCT query_id, query_text, name FROM (SELECT * FROM query_rows WHERE may_embed_symbol AND NOT is_symbol) q{d.unnest(d.cat(camel, leaves), 'a', 'name')}"
    suffixed = "contains(lower(query_text), 'attribute')"
    return f"""SELECT DISTINCT query_id, name, 3.0 AS unit, main FROM (SELECT * FROM (SELECT query_id, {leaf} AS name, true AS main FROM query_rows WHERE is_symbol) a
      UNION ALL SELECT query_id, {text.trimmed(d, q)} AS name, {leaf} = {text.trimmed(d, q)} AS main FROM query_rows WHERE is_symbol) x WHERE name <> ''
    UNION ALL SELECT query_id, CASE WHEN {suffixed} AND open > 0 THEN concat(name, 'Attribute') ELSE name END AS name, 1.5 AS unit, false AS main FROM (
      SELECT *, sum(CASE WHEN {d.ends("name", "'Attribute'")} THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS open FROM ({embedded}) e) y
      WHERE NOT ({suffixed} AND open > 0 AND {d.ends("name", "'Attribute'")})"""


@stage
def file_stem_forms(d: Spark) -> str:
    """The four forms under which a stem matches a name."""
    forms = lambda s: d.array(s, f"replace({s}, '_', '')", f"rtrim({s}, 's')", f"rtrim(replace({s}, '_', ''), 's')")
    spark_forms = lambda s: d.array(s, f"replace({s}, '_', '')", f"rtrim('s', {s})", f"rtrim('s', replace({s}, '_', ''))")
    use = spark_forms if d.name == "spark" else forms
    return f"SELECT DISTINCT file_path, form FROM (SELECT file_path, {use('stem')} AS forms FROM file_features) f{d.unnest('forms', 'a', 'form')}"


@stage
def public_words(d: Spark) -> str:
    """The words that stand in files with a public role; what such a file defines is among them."""
    words = d.distinct(d.split("content", "[^A-Za-z0-9_]+"))
    return f"SELECT chunk_id, word FROM (SELECT c.chunk_id, c.content FROM chunk_rows c JOIN file_features f ON c.file_path = f.file_path WHERE f.is_public) c{d.unnest(words, 'a', 'word')} WHERE word <> ''"


@stage
def definition_places(d: Spark) -> str:
    """Where a named symbol may be defined: the candidates, and files that its name or their role points to."""
    prefixes = f"SELECT DISTINCT query_id, substr(low, 1, n) AS prefix, n = length(low) AS whole FROM (SELECT query_id, lower(name) AS low FROM query_names WHERE unit < 2) x{d.unnest(d.range('1', 'CAST(greatest(length(low), 1) AS INT)') if d.name == 'spark' else d.range('1', 'greatest(length(low), 1)'), 'a', 'n')}"
    return f"""SELECT query_id, chunk_id FROM coherent WHERE query_id IN (SELECT query_id FROM query_names)
    UNION SELECT n.query_id, c.chunk_id FROM query_names n JOIN file_stem_forms f ON lower(n.name) = f.form JOIN chunk_keys c ON f.file_path = c.file_path WHERE n.main
    UNION SELECT n.query_id, w.chunk_id FROM query_names n JOIN public_words w ON n.name = w.word WHERE n.unit > 2
    UNION SELECT p.query_id, c.chunk_id FROM ({prefixes}) p JOIN (SELECT file_path, stem AS form FROM file_features UNION SELECT file_path, replace(stem, '_', '') FROM file_features) f
      ON p.prefix = f.form AND (p.whole OR length(f.form) >= 4) JOIN chunk_keys c ON f.file_path = c.file_path"""


@stage(heavy=True)
def definition_tiers(d: Spark) -> str:
    """What chunks gain that define a symbol of the query; half as much again where the file is named after it."""
    lines = d.filter(d.split("c.content", "\n"), "w", f"contains(w, 'pub use') AND {d.has(d.split('w', '[^A-Za-z0-9_]+'), 'n.name')}")
    defines = f"({d.match_text('c.content', _definition(d, DEFINERS, False, 'n.name'))} OR {d.match_text('c.content', _definition(d, SQL_DEFINERS, True, 'n.name'))} OR (f.is_public AND {d.size(lines)} > 0))"
    return f"""SELECT query_id, chunk_id, max(unit) * CASE WHEN max(named) = 1 THEN 1.5 ELSE 1.0 END AS tier, max(defined) AS defined FROM (
      SELECT p.query_id, p.chunk_id, n.unit, CASE WHEN s.form IS NOT NULL THEN 1 ELSE 0 END AS named, CASE WHEN contains(lower(c.content), lower(n.name)) AND {defines} THEN 1 ELSE 0 END AS defined
      FROM definition_places p JOIN query_names n ON p.query_id = n.query_id JOIN chunk_rows c ON p.chunk_id = c.chunk_id JOIN file_features f ON c.file_path = f.file_path
      LEFT JOIN file_stem_forms s ON s.file_path = c.file_path AND s.form = lower(n.name)) x GROUP BY query_id, chunk_id HAVING max(defined) = 1"""


@stage
def stem_boosts(d: Spark) -> str:
    """Per query and file: query words that a file's stem or directory answers, and whether a public interface is asked for."""
    words = f"SELECT DISTINCT t.query_id, t.term FROM query_terms t JOIN query_rows q ON t.query_id = q.query_id WHERE q.stem_boost AND NOT q.is_symbol AND length(t.term) > 2 AND t.term NOT IN {text.stop_list()}"
    near = f"(w.term = f.part OR (length(w.term) >= 3 AND {d.starts('f.part', 'w.term')}) OR (length(f.part) >= 3 AND {d.starts('w.term', 'f.part')}))"
    public = ", ".join(f"'{w}'" for w in classify.PUBLIC_WORDS)
    return f"""SELECT m.query_id, m.file_path, CAST(m.matches AS DOUBLE) / k.n AS share, CASE WHEN k.public = 1 AND f.is_public THEN 0.8 ELSE 0.0 END AS public FROM (
      SELECT query_id, file_path, sum(CASE WHEN hit = 1 THEN 1 + syn ELSE 2 * syn END) AS matches FROM (
        SELECT w.query_id, f.file_path, w.term, max(CASE WHEN {near} THEN 1 ELSE 0 END) AS hit, max(CASE WHEN w.term IN ('implementation', 'implementations') AND f.part = 'impls' THEN 1 ELSE 0 END) AS syn
        FROM ({words}) w JOIN (SELECT DISTINCT query_id, file_path FROM coherent) c ON w.query_id = c.query_id
        JOIN (SELECT file_path, part FROM file_features{d.unnest("stem_parts", "a", "part")}) f ON c.file_path = f.file_path GROUP BY w.query_id, f.file_path, w.term) x GROUP BY query_id, file_path) m
    JOIN (SELECT query_id, count(*) AS n, max(CASE WHEN term IN ({public}) THEN 1 ELSE 0 END) AS public FROM ({words}) w GROUP BY query_id) k ON m.query_id = k.query_id
    JOIN file_features f ON m.file_path = f.file_path"""


@stage
def maxima(d: Spark) -> str:
    return "SELECT query_id, max(m) AS m FROM coherent WHERE m > 0 GROUP BY query_id"


@stage(heavy=True)
def named_boosted(d: Spark) -> str:
    """Candidates after the boosts for stems and definitions; chunks that define a symbol join them if they pass the filter."""
    return f"""SELECT c.query_id, c.chunk_id, c.file_path, round(c.score + c.m * (coalesce(s.share, 0.0) + coalesce(s.public, 0.0)) + c.m * coalesce(t.tier, 0.0), 9) AS score, c.m FROM coherent c
      LEFT JOIN stem_boosts s ON c.query_id = s.query_id AND c.file_path = s.file_path LEFT JOIN definition_tiers t ON c.query_id = t.query_id AND c.chunk_id = t.chunk_id
    UNION ALL SELECT t.query_id, t.chunk_id, k.file_path, round(x.m * t.tier, 9) AS score, x.m FROM definition_tiers t JOIN maxima x ON t.query_id = x.query_id JOIN query_rows q ON t.query_id = q.query_id
      JOIN chunk_keys k ON t.chunk_id = k.chunk_id LEFT JOIN coherent c ON c.query_id = t.query_id AND c.chunk_id = t.chunk_id WHERE c.chunk_id IS NULL AND {_allowed(d, "k")}"""


@stage(heavy=True)
def path_overlaps(d: Spark) -> str:
    """Terms that a query and a path share, and whether one of them names the file."""
    matches = f"SELECT DISTINCT p.file_path, f.form FROM (SELECT file_path, part FROM file_features{d.unnest('own_parts', 'a', 'part')}) p JOIN ({{}}) f ON p.part = f.part"
    rtrim = (lambda s: f"rtrim('s', {s})") if d.name == "spark" else (lambda s: f"rtrim({s}, 's')")
    forms = f"SELECT DISTINCT part, form FROM (SELECT part, {d.array('part', "replace(part, '_', '')", rtrim('part'), rtrim("replace(part, '_', '')"))} AS fs FROM (SELECT DISTINCT part FROM file_features{d.unnest('own_parts', 'a', 'part')}) x) y{d.unnest('fs', 'b', 'form')}"
    return f"""SELECT query_id, file_path, CAST(sum(shared) AS BIGINT) AS overlap, max(named) AS named FROM (
      SELECT t.query_id, f.file_path, count(*) AS shared, 0 AS named FROM query_path_terms t JOIN (SELECT file_path, term FROM file_features{d.unnest("path_terms", "a", "term")}) f ON t.term = f.term GROUP BY t.query_id, f.file_path
      UNION ALL SELECT DISTINCT t.query_id, s.file_path, 0 AS shared, 1 AS named FROM query_path_terms t JOIN ({matches.format(forms)}) s ON t.term = s.form) x GROUP BY query_id, file_path"""


@stage(heavy=True)
def path_boosted(d: Spark) -> str:
    """After the boosts for what the query says about paths; up to 32 chunks of files that share two terms join the candidates."""
    has = lambda *w: " OR ".join(d.has("f.path_terms", f"'{x}'") for x in w)
    added = f"""CASE WHEN coalesce(o.overlap, 0) > 0 THEN least(0.18 * o.overlap, 0.7) ELSE 0.0 END + CASE WHEN o.named = 1 THEN 0.35 ELSE 0.0 END + CASE WHEN q.wants_public_api AND ({has("api", "public")}) THEN 0.5 ELSE 0.0 END
      + CASE WHEN q.wants_test_file AND f.is_test_lower THEN 0.7 ELSE 0.0 END + CASE WHEN q.wants_docs AND ({has("doc", "docs")}) THEN 0.6 ELSE 0.0 END + CASE WHEN q.wants_examples AND f.is_example_lower THEN 0.6 ELSE 0.0 END"""
    return f"""SELECT c.query_id, c.chunk_id, c.file_path, round(CASE WHEN q.path_intent THEN c.score * CASE WHEN q.wants_source_file AND (f.is_test_file_lower OR f.is_example_lower) THEN 0.8 ELSE 1.0 END + c.m * CAST({added} AS DOUBLE) ELSE c.score END, 9) AS score FROM (
      SELECT query_id, chunk_id, file_path, score, m FROM named_boosted
      UNION ALL SELECT query_id, chunk_id, file_path, round(m * least(0.25 + 0.2 * overlap, 0.9), 9) AS score, m FROM (
        SELECT o.query_id, k.chunk_id, k.file_path, o.overlap, x.m, row_number() OVER (PARTITION BY o.query_id ORDER BY k.chunk_id) AS n FROM path_overlaps o JOIN maxima x ON o.query_id = x.query_id
        JOIN query_rows q ON o.query_id = q.query_id JOIN chunk_keys k ON o.file_path = k.file_path LEFT JOIN named_boosted b ON b.query_id = o.query_id AND b.chunk_id = k.chunk_id
        WHERE o.overlap >= 2 AND q.path_intent AND b.chunk_id IS NULL AND {_allowed(d, "k")}) y WHERE n <= 32) c
    JOIN query_rows q ON c.query_id = q.query_id JOIN file_features f ON c.file_path = f.file_path LEFT JOIN path_overlaps o ON o.query_id = c.query_id AND o.file_path = c.file_path"""


# ---- rerank --------------------------------------------------------------------------------------------------------


@stage(heavy=True)
def penalised(d: Spark) -> str:
    """Scores after the penalties for paths a query did not ask for."""
    factor = """CASE WHEN f.is_test AND NOT q.allow_tests THEN 0.3 ELSE 1.0 END * CASE WHEN f.is_stub THEN 0.5 ELSE 1.0 END * CASE WHEN f.is_compat THEN 0.3 ELSE 1.0 END
      * CASE WHEN f.is_example AND NOT q.allow_examples THEN 0.3 ELSE 1.0 END * CASE WHEN f.is_type_def AND NOT q.allow_type_defs THEN 0.7 ELSE 1.0 END"""
    return f"""SELECT b.query_id, b.chunk_id, b.file_path, b.score AS boosted, CASE WHEN q.alpha < 1 THEN CAST({factor} AS DOUBLE) ELSE 1.0 END AS penalty,
      b.score * CASE WHEN q.alpha < 1 THEN CAST({factor} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS score
    FROM path_boosted b JOIN query_rows q ON b.query_id = q.query_id JOIN file_features f ON b.file_path = f.file_path"""


@stage(heavy=True)
def hybrid_hits(d: Spark) -> str:
    """Each chunk of a file after its first counts half as much as the one before it; then the query's top k."""
    return """SELECT query_id, chunk_id, file_path, score, rank FROM (
      SELECT query_id, chunk_id, file_path, score, top_k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, file_path, top_k, round(score * power(0.5, n - 1), 6) AS score FROM (
          SELECT p.query_id, p.chunk_id, p.file_path, p.score, q.top_k, row_number() OVER (PARTITION BY p.query_id, p.file_path ORDER BY p.score DESC, p.chunk_id) AS n
          FROM penalised p JOIN query_rows q ON p.query_id = q.query_id) x) y) z WHERE rank <= top_k"""


# ---- evaluation ----------------------------------------------------------------------------------------------------


def finds(d: Spark, h: str, t: str) -> str:
    """Whether a hit is what a target means: the same path or the end of it, and lines that overlap where both name lines."""
    slash = lambda p: f"replace({p}, {d.lit(chr(92))}, '/')"
    hit, target = slash(f"{h}.file_path"), slash(f"{t}.path")
    path = f"({hit} = {target} OR {d.ends(hit, f"concat('/', {target})")} OR {d.ends(target, f"concat('/', {hit})")})"
    return f"({path} AND ({t}.first_line IS NULL OR {t}.last_line IS NULL OR NOT ({h}.end_line < {t}.first_line OR {h}.start_line > {t}.last_line)))"


def target_ranks(d: Spark, hits: str, stride: int = STRIDE) -> str:
    """``(query_id, path, first_line, rank)``: the first hit of every query that finds its target, null if none does."""
    found = f"SELECT q.query_id, t.path, t.first_line, min(h.rank) AS rank FROM query_rows q JOIN targets t ON t.place = CAST(floor(q.query_id / {stride}) AS BIGINT) + 1 JOIN (SELECT h.query_id, h.rank, c.file_path, c.start_line, c.end_line FROM {hits} h JOIN chunk_keys c ON h.chunk_id = c.chunk_id) h ON h.query_id = q.query_id AND {finds(d, 'h', 't')} GROUP BY q.query_id, t.path, t.first_line"
    return f"SELECT q.query_id, t.path, t.first_line, f.rank FROM query_rows q JOIN targets t ON t.place = CAST(floor(q.query_id / {stride}) AS BIGINT) + 1 LEFT JOIN ({found}) f ON f.query_id = q.query_id AND f.path = t.path AND f.first_line = t.first_line"


@stage(heavy=True)
def final_ranks(d: Spark) -> str:
    return target_ranks(d, "hybrid_hits")


@stage
def bm25_ranks(d: Spark) -> str:
    return target_ranks(d, "bm25_hits")


@stage
def semantic_ranks(d: Spark) -> str:
    return target_ranks(d, "dense_hits")

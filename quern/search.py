"""Search over any table of chunks: the library's front door."""

from __future__ import annotations

import datetime
import math
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dialect import SPARK
from quern.functions.text import semantic_text
from quern.operators.encoders import Encoder, encode_texts
from quern.plans import catalog
from quern.plans.runner import Run
from quern.plans.stages import COLUMNS
from quern.session import cut, stored
from quern.sources import chunking, stores, tree

CHUNKS = "chunk_id bigint, repo string, file_path string, start_line bigint, end_line bigint, language string, content string, symbols array<struct<name:string,kind:string,line:bigint>>, breadcrumbs array<string>, indexed_at timestamp"
QUERIES = "query_id bigint, query_text string, search_mode string, top_k int, alpha double, filter_languages array<string>, filter_paths array<string>, issued_at timestamp"
_STAGE = {"bm25": "bm25_hits", "semantic": "dense_hits", "hybrid": "hybrid_hits"}
#: What an index keeps between runs; the vectors only once they are asked for.
SPARSE = ("chunk_rows", "postings_built", "term_frequencies", "corpus_stats", "symbol_rows", "file_features", "file_terms", "file_stem_forms", "public_words")
VECTORS = ("chunk_vectors",)
#: The vectors of an encoder take their place.
ENCODED = "encoded_chunks"
ALPHAS = (0.25, 0.45, 0.65, 0.85)
_ASKED = {"asked_queries": lambda d: "SELECT * FROM queries"}


def with_symbols(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Chunks that follow their file's structure with the symbols they declare, and a breadcrumb for each."""
    found = Run(spark, {"chunks": chunks.where("outlined")}).sql(catalog.extract_symbols(SPARK))
    lists = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))).alias("_s"))
    joined = chunks.drop("symbols", "breadcrumbs").join(lists, "chunk_id", "left")
    symbols = F.transform(F.coalesce("_s", F.expr("cast(array() as array<struct<line:bigint,kind:string,name:string>>)")), lambda s: F.struct(s.getField("name").alias("name"), s.getField("kind").alias("kind"), s.getField("line").alias("line")))
    crumbs = F.transform("symbols", lambda s: F.concat(s.getField("kind"), F.lit(" "), s.getField("name")))
    return joined.withColumn("symbols", symbols).withColumn("breadcrumbs", crumbs).drop("_s", "outlined")


def tree_chunks(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The chunks of a tree's files, numbered in the order of their paths' components, then of their place in the file."""
    made = cut(chunking.chunk_files(files))
    # Only a count per file goes through one task.
    counts = made.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.split("file_path", "/")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("ordinal")) - 1
    rows = made.withColumn("_place", place).join(counts.select("file_path", before.alias("_before")), "file_path")
    filled = rows.select(
        (F.col("_before") + F.col("_place")).cast("bigint").alias("chunk_id"), F.element_at(F.split("file_path", "/"), 1).alias("repo"), "file_path", "start_line", "end_line", "language", "content",
        F.lit(None).cast("array<struct<name:string,kind:string,line:bigint>>").alias("symbols"), F.expr("cast(array() as array<string>)").alias("breadcrumbs"), F.lit(None).cast("timestamp").alias("indexed_at"), "outlined",
    )
    return with_symbols(spark, filled)


class Index:
    """Chunks to be searched.

    The index tables are built once, on the first search, and answer all that follow; with ``folder`` they are stored and
    found again by a later session.  Results of a repeated batch come from a small store, cleared when it is full.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, cached: int = 256, folder: str | None = None, identity: str = "", encoder: Encoder | None = None) -> None:
        self.spark, self.chunks, self.cached, self.store = spark, chunks, cached, {}
        self.folder, self.encoder = folder, encoder
        # Vectors of another encoder or model are those of another index.
        self.identity = identity + (f" {type(encoder).__name__} {getattr(encoder, 'fingerprint', encoder.dim)}" if encoder is not None else "")
        self.warnings: DataFrame | None = None
        self.root: str | None = None
        self.options: dict = {}
        self.built: dict[str, DataFrame] = {}

    # ---- building ----

    @classmethod
    def from_chunks(cls, spark: SparkSession, chunks: DataFrame, **options) -> Index:
        return cls(spark, chunks, **options)

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, folder: str | None = None, encoder: Encoder | None = None, **options) -> Index:
        """The files below a folder that all workers see.  A stored index of the same files and options is taken as it is."""
        _, path, source = tree.resolve_source(root)
        identity = stores.index_key(source, {k: sorted(v) if isinstance(v, (list, set, tuple)) else v for k, v in options.items()})
        now = cls._signatures(spark, path, options)
        kept = stores.load_tables(spark, folder, cls(spark, now, identity=identity, encoder=encoder).identity) if folder else None
        if kept and stores.signature_changes(kept["signatures"], now).isEmpty():
            made = cls(spark, kept["chunk_rows"].withColumn("indexed_at", F.lit(None).cast("timestamp")), folder=folder, identity=identity, encoder=encoder)
            made.built = {n: df for n, df in kept.items() if n in (*SPARSE, *VECTORS, ENCODED)}
            made.warnings = kept["warnings"]
        else:
            files, warnings = tree.read_tree(spark, path, **options)
            made = cls(spark, cut(tree_chunks(spark, files)), folder=folder, identity=identity, encoder=encoder)
            made.warnings = warnings
            if made.chunks.isEmpty():
                raise ValueError("No supported files found.")
        made.root, made.options, made.signatures = path, options, now
        return made

    @classmethod
    def from_git(cls, spark: SparkSession, url: str, ref: str | None = None, offline: bool = False, into: str | None = None, **options) -> Index:
        return cls.from_tree(spark, tree.clone(url, ref, offline, into), **options)

    @staticmethod
    def _signatures(spark: SparkSession, root: str, options: dict) -> DataFrame:
        types = tree.extensions(options.get("only"), options.get("include_documents", False))
        return tree.signatures(spark, root, tree.walk(root, types, options.get("ignore", ())))

    def build(self, semantic: bool = False) -> Index:
        """Build what is missing of the index tables, and store them where the index has a folder."""
        vectors = () if not semantic else VECTORS if self.encoder is None else (ENCODED,)
        wanted = [n for n in (*SPARSE, *vectors) if n not in self.built]
        if wanted:
            run = Run(self.spark, {"chunks": self.chunks}, _ASKED, self.built)
            made = {n: run.stage(n) if n in COLUMNS else stored(run.stage(n)) for n in wanted if n != ENCODED}
            if ENCODED in wanted:
                texts = run.sql(f"SELECT chunk_id, {semantic_text(SPARK)} AS s FROM chunk_rows")
                made[ENCODED] = stored(encode_texts(texts, self.encoder, "chunk_id", "s"))
            if self.folder:
                extra = {"signatures": self.signatures} if self.root else {}
                extra |= {"warnings": self.warnings} if self.warnings is not None else {}
                stores.save_tables(self.built | made | extra, self.folder, self.identity)
                kept = stores.load_tables(self.spark, self.folder, self.identity)
                made = {n: kept[n] for n in (*self.built, *made)}
            self.built |= made
        return self

    def warm_semantic(self) -> Index:
        return self.build(semantic=True)

    @property
    def semantic_loaded(self) -> bool:
        return all(n in self.built for n in (VECTORS if self.encoder is None else (ENCODED,)))

    def is_fresh(self) -> bool | None:
        """Whether the files are those that were indexed; None if the index is not of a folder."""
        if self.root is None:
            return None
        return stores.signature_changes(self.signatures, self._signatures(self.spark, self.root, self.options)).isEmpty()

    # ---- searching ----

    def _run(self, texts: list[str], mode: str, top_k: int, alpha: float | None, languages: list[str] | None, paths: list[str] | None) -> Run:
        if mode not in _STAGE:
            raise ValueError(f"mode is one of {', '.join(_STAGE)}")
        if top_k < 1 or (alpha is not None and not 0 <= alpha <= 1):
            raise ValueError("top_k is at least 1 and alpha between 0 and 1")
        if any(not isinstance(x, str) for x in (*texts, *(languages or ()), *(paths or ()))):
            raise ValueError("queries, languages and paths are texts")
        self.build(semantic=mode != "bm25")
        now = datetime.datetime(2000, 1, 1)
        asked = [(i, t, mode, top_k, alpha, languages or [], paths or [], now) for i, t in enumerate(texts) if t.strip()]
        run = Run(self.spark, {"chunks": self.chunks, "queries": self.spark.createDataFrame(asked, QUERIES)}, _ASKED, self.built)
        run.encoder = self.encoder
        return run

    def search(self, texts: list[str], mode: str = "hybrid", top_k: int = 5, alpha: float | None = None, languages: list[str] | None = None, paths: list[str] | None = None, use_cache: bool = True, explain: bool = False) -> list:
        """Rows ``(query_id, rank, chunk_id, file_path, start_line, end_line, score, content)``; query_id is the place in ``texts``.

        ``explain`` adds what the score is made of, in hybrid mode.
        """
        key = (tuple(texts), mode, top_k, alpha, tuple(languages or ()), tuple(paths or ()), explain)
        if key in self.store and use_cache:
            return self.store[key]
        run = self._run(texts, mode, top_k, alpha, languages, paths)
        hits = f"SELECT h.query_id, h.rank, h.chunk_id, c.file_path, c.start_line, c.end_line, h.score, c.content FROM {_STAGE[mode]} h JOIN chunk_rows c ON h.chunk_id = c.chunk_id WHERE h.rank <= {int(top_k)}"
        if not any(t.strip() for t in texts):
            rows = []
        elif explain and mode == "hybrid":
            rows = run.sql(hits).join(run.sql(catalog.CATALOG["hybrid_explain"](SPARK)).drop("rank"), ["query_id", "chunk_id"]).collect()
        else:
            rows = run.sql(hits).collect()
        rows = sorted(rows, key=lambda r: (r.query_id, r["rank"]))
        if use_cache:
            if len(self.store) >= self.cached:
                self.store.clear()
            self.store[key] = rows
        return rows

    def search_with(self, text: str, mode: str = "hybrid", top_k: int = 5, **options) -> dict:
        """One query's hits with what a caller shows beside them."""
        began = time.perf_counter()
        hits = self.search([text], mode, top_k, **options)
        truncated = len(hits) >= top_k
        return {
            "query": text, "mode": mode, "hits": hits, "limit": top_k, "truncated": truncated, "hint": "Raise the limit to see more results." if truncated else None,
            "warnings": self.filter_warnings(options.get("languages"), options.get("paths")), "elapsed_ms": (time.perf_counter() - began) * 1000,
        }

    def filter_warnings(self, languages: list[str] | None = None, paths: list[str] | None = None) -> list[str]:
        if not languages and not paths:
            return []
        found = self._run(["x"], "bm25", 1, None, languages, paths).sql(catalog.warnings(SPARK)).collect()
        known = ", ".join(sorted(self.stats()["languages"])) if any(r.kind == "language" for r in found) else ""
        out = []
        for r in found:
            if r.kind == "language":
                out.append(f"No indexed chunks matched language {r.wanted!r}. Indexed languages: {known}")
            elif r.suggestion:
                out.append(f"No indexed file matched path {r.wanted!r}. Did you mean {r.suggestion!r}?")
            else:
                out.append(f"No indexed file matched path {r.wanted!r}.")
        return out

    def find_related(self, file_path: str, line: int, top_k: int = 5) -> list:
        """The chunks of the same language that are most similar to the one at a file's line."""
        at = self.chunk_at(file_path, line)
        if at is None:
            return []
        hits = self.search([at.content], "semantic", top_k + 1, languages=[at.language] if at.language else None)
        return [h for h in hits if h.chunk_id != at.chunk_id][:top_k]

    def pack(self, texts: list[str], tokens: int = 6000, top_k: int = 20, **options) -> list:
        """Rows ``(query_id, chunk_id, kind, place, taken, content)``: what fits in so many tokens per query."""
        run = self._run(texts, "hybrid", top_k, options.get("alpha"), options.get("languages"), options.get("paths"))
        return sorted(run.sql(catalog.pack(SPARK, tokens)).collect(), key=lambda r: (r.query_id, r.place)) if any(t.strip() for t in texts) else []

    # ---- evaluating ----

    def evaluate(self, cases: list[tuple[str, str]], mode: str = "hybrid", limit: int = 10, alpha: float | None = None) -> dict:
        """How well ``(query, expected)`` cases are answered; expected is a path, or the beginning of a place ``path:first-last``."""
        texts = [q for q, _ in cases]
        ranks: dict[int, int] = {}
        for h in self.search(texts, mode, limit, alpha) if cases else []:
            expected = cases[h.query_id][1]
            if h.file_path == expected or f"{h.file_path}:{h.start_line}-{h.end_line}".startswith(expected):
                ranks.setdefault(h.query_id, h["rank"])
        n = len(cases)
        mean = lambda values: sum(values) / n if n else 0.0
        return {"mode": mode, "alpha": alpha, "cases": n, "hits": len(ranks), "hit_rate": mean([1.0] * len(ranks)), "mrr": mean([1 / r for r in ranks.values()]), "ndcg": mean([1 / math.log2(r + 1) for r in ranks.values()])}

    def tune(self, cases: list[tuple[str, str]], limit: int = 10) -> dict:
        """The three modes and hybrid with four alphas on the same cases; the best is the last of the highest gain."""
        tried = [self.evaluate(cases, mode, limit) for mode in ("bm25", "semantic", "hybrid")] + [self.evaluate(cases, "hybrid", limit, a) for a in ALPHAS] if cases else []
        return {"evaluations": tried, "best": max(enumerate(tried), key=lambda t: (t[1]["ndcg"], t[0]))[1] if tried else None}

    # ---- looking up ----

    def _rows(self) -> DataFrame:
        return self.build().built["chunk_rows"]

    def chunk_at(self, file_path: str, line: int):
        """The chunk that holds a line: one that goes on beyond it, else one that ends with it; None if there is none."""
        holding = self._rows().where((F.col("file_path") == file_path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
        return next(iter(holding.orderBy(F.col("end_line") == line, "chunk_id").limit(1).collect()), None)

    def chunks_for_file(self, file_path: str) -> list:
        return self._rows().where(F.col("file_path") == file_path).orderBy("chunk_id").collect()

    def indexed_files(self, limit: int = 200) -> dict:
        """The first paths in order, the number of all, and whether some are not shown."""
        files = self._rows().select("file_path").distinct()
        shown, total = [r.file_path for r in files.orderBy("file_path").limit(limit).collect()], files.count()
        return {"files": shown, "total": total, "truncated": total > len(shown)}

    def stats(self) -> dict:
        rows = self._rows()
        total = rows.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks")).collect()[0]
        languages = {r.language: r.n for r in rows.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy("language").collect()}
        return {"indexed_files": total.files, "total_chunks": total.chunks, "languages": languages}

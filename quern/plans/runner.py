"""Runs stages on Spark, and writes the same stages as one SQL statement for the check engine."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dialect import DUCK, GREATEST_POOL, SPARK
from quern.operators.dense import block_hits
from quern.operators.encoders import Encoder
from quern.operators.postings import chunk_postings, hashed_chunks
from quern.operators.ranked import ranked
from quern.operators.sparse import BROUGHT, bm25_sums
from quern.plans.stages import BOTH_NAME, COLUMNS, HEAVY, RRF, STAGES, Stage
from quern.session import cut, stored, table

#: Tables that a stage may read besides other stages.
TABLES = ("chunks", "queries", "signatures", "documents", "vectors", "rank_evidence", "events")

#: Stages whose text is for the check engine only: on Spark, batches of rows go through arrays.
IN_BLOCKS = {"chunk_rows": lambda run: latest_chunks(run), "bm25_hits": bm25_sums, "dense_hits": block_hits, "postings_built": chunk_postings, "chunk_vectors": hashed_chunks}

#: Up to so many chunks that were delivered more than once, their ids go to all readers of the chunks.
REPEATED = 2_000_000

#: Stages that come about in arrays where a statement needs no stage between them and the queries.
RANKED = {"hybrid_hits": "hits", "path_boosted": "boosted", "stem_boosts": "stems"}
#: Stages that are gone then.
BETWEEN = {"bm25_hits", "dense_hits", "rrf_parts", "agreement", "fused", "coherent", "definition_places", "definition_tiers", "maxima", "named_boosted", "penalised", "bm25_ranks", "semantic_ranks"}

_runs = itertools.count()


def _names(sql: str, among: tuple[str, ...] | list[str]) -> list[str]:
    return [n for n in among if re.search(rf"(?:FROM|JOIN|,)\s+\(?{n}\b", sql)]


def needed(sql: str, stages: dict[str, Stage] = STAGES) -> list[str]:
    """The stages that a statement needs, in order."""
    found: set[str] = set()
    todo = _names(sql, list(stages))
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo.extend(_names(stages[n](DUCK), list(stages)))
    return [n for n in stages if n in found]


def duck_sql(sql: str, instead: dict[str, Stage] | None = None) -> str:
    """A statement with the stages it needs as common table expressions; ``instead`` has stages that take others' places."""
    stages = STAGES | (instead or {})
    parts = [f"{n} AS MATERIALIZED ({stages[n](DUCK)})" for n in needed(sql, stages)]
    return (f"WITH {',\n'.join(parts)}\n" if parts else "") + sql


class Run:
    """The stages over one data directory; each is planned once, heavy ones are written once."""

    def __init__(self, spark: SparkSession, source: str | dict[str, DataFrame], instead: dict[str, Stage] | None = None, built: dict[str, DataFrame] | None = None) -> None:
        """``source`` has the tables, ``instead`` stages that take others' places, ``built`` stages that are there already."""
        self.spark, self.source, self.prefix = spark, source, f"quern_{next(_runs)}_"
        self.stages = STAGES | (instead or {})
        self.done: dict[str, DataFrame] = {}
        #: Vectors of another origin than the hashed tokens.
        self.encoder: Encoder | None = None
        #: Whether the statement at hand reads the hits of both retrievers.
        self.hybrid = False
        for name, df in (built or {}).items():
            self._view(name, df)

    def _view(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self.prefix + name)
        self.done[name] = df

    def offer(self, name: str, df: DataFrame) -> None:
        """A stage that came about with another, for what is planned later."""
        if name not in self.done:
            self._view(name, df)

    def _bind(self, sql: str, names: list[str]) -> str:
        for n in names:
            sql = re.sub(rf"((?:FROM|JOIN|,)\s+\(?){n}\b", rf"\g<1>{self.prefix}{n}", sql)
        if GREATEST_POOL in sql:
            pool = self.stage("query_rows").selectExpr("coalesce(max(pool), 0) AS pool").collect()[0].pool
            sql = sql.replace(GREATEST_POOL, str(pool))
        return sql

    def _tables(self, sql: str) -> None:
        for t in _names(sql, TABLES):
            if t not in self.done:
                self._view(t, self.source[t] if isinstance(self.source, dict) else table(self.spark, self.source, t))

    def stage(self, name: str) -> DataFrame:
        if name not in self.done:
            made = IN_BLOCKS.get(name)
            df = self._joined(name) or (made(self) if made else self._stated(name))
            kept = name in self.done or name == "chunk_rows" and self.lazy or name in ("bm25_hits", "fused") and "both_hits" in self.done
            self._view(name, df if kept else stored(df) if name in COLUMNS else cut(df) if name in HEAVY else df)
        return self.done[name]

    @property
    def lazy(self) -> bool:
        """Whether chunks are read from their table each time, instead of being written once more."""
        return isinstance(self.source, str)

    def _joined(self, name: str) -> DataFrame | None:
        """What takes less where a batch is known: terms of files, and what is made of the hits of both retrievers, where they
        came about together and no join brings them together again."""
        if name == "file_terms" and self.lazy and "query_rows" in self.done:
            # Only terms that the batch may ask for are counted by file.
            asked = self.stage("query_terms").join(self.stage("query_rows").where("is_file_card OR is_broad"), "query_id").where("length(term) >= 3").select("term").distinct()
            self._view("asked_terms", asked)
            text = self.stages[name](SPARK)
            parts, tail = text.rsplit(") x GROUP BY", 1)
            return self._stated(name, f"{parts}) x LEFT SEMI JOIN {self.prefix}asked_terms w ON x.term = w.term GROUP BY{tail}")
        if "both_hits" not in self.done:
            return None
        both, queries = f"{self.prefix}both_hits", f"{self.prefix}query_rows"
        if name == "rrf_parts":
            parts = f"coalesce(q.alpha / ({RRF} + h.dense_rank), 0.0D) + coalesce((1 - q.alpha) / ({RRF} + h.bm25_rank), 0.0D)"
            return self.spark.sql(f"SELECT h.query_id, h.chunk_id, {parts} AS part FROM {both} h JOIN {queries} q ON h.query_id = q.query_id")
        if name == "agreement":
            near, far = ("named_struct('query_id', query_id, 'chunk_id', chunk_id, 'rank', dense_rank) AS s", "named_struct('rank', bm25_rank) AS m")
            return self.spark.sql(self.stages[name](SPARK).replace(BOTH_NAME, f"(SELECT {near}, {far} FROM {both} WHERE dense_rank <= 50 AND bm25_rank <= 50) h"))
        if name == "fused":
            # By chunk, as is needed next: the sums need no shuffle of their own, and what reads them once is not written.
            head, rest = self.stages[name](SPARK).split("FROM (", 1)
            parts, tail = rest.rsplit(") x GROUP BY", 1)
            return self._stated(name, f"{head}FROM (SELECT /*+ REPARTITION(chunk_id) */ * FROM ({parts}) u) x GROUP BY{tail}")
        return None

    def _stated(self, name: str, text: str | None = None) -> DataFrame:
        text = text or self.stages[name](SPARK)
        inputs = _names(self.stages[name](DUCK), list(self.stages))
        for n in inputs:
            self.stage(n)
        self._tables(text)
        return self.spark.sql(self._bind(text, [*inputs, *_names(text, TABLES)]))

    def _ranked(self, text: str, by_hits: bool) -> str | None:
        """The stage that can be made without those between the queries and it."""
        if self.encoder is not None or {"postings_built", "chunk_vectors", "dense_hits", "both_hits"} & set(self.done) or not self.lazy:
            return None
        bare = {n: (lambda d: "") if n in RANKED or by_hits and n in BETWEEN else s for n, s in self.stages.items()}
        every = needed(text, bare)
        found = [n for n in RANKED if n in every]
        return found[0] if len(found) == 1 and (by_hits or not BETWEEN & set(every)) and self.few_terms() else None

    def few_terms(self) -> bool:
        return self.stage("query_terms").select("term").distinct().count() <= BROUGHT

    def _of_ranked(self, name: str, by_hits: bool) -> DataFrame:
        made = ranked(self, RANKED[name])
        if name == "path_boosted":
            return made
        made = stored(made) if by_hits else made
        if by_hits:
            self._view("penalised", made.select("query_id", "chunk_id", "boosted"))
            for n, score, rank in (("fused", "rrf", None), ("bm25_hits", "bm25_score", "bm25_rank"), ("dense_hits", "dense_score", "dense_rank")):
                self._view(n, made.where(f"{score} is not null").selectExpr("query_id", "chunk_id", f"{score} as score", *[f"{rank} as rank"] * bool(rank)))
        return made.select("query_id", "file_path", "share", "public") if name == "stem_boosts" else made.select("query_id", "chunk_id", "file_path", "score", "rank")

    def sql(self, text: str, by_hits: bool = False) -> DataFrame:
        """A statement over tables and stages; ``by_hits`` where it joins all others to the rows of ``hybrid_hits``."""
        names = _names(text, list(self.stages))
        every = needed(text, self.stages)
        self.hybrid = {"bm25_hits", "dense_hits"} <= set(every)
        ranked = self._ranked(text, by_hits) if self.hybrid else None
        if ranked:
            self._view(ranked, self._of_ranked(ranked, by_hits))
        elif "bm25_hits" in every:
            # First, as it offers the corpus's statistics to the others.
            self.stage("bm25_hits")
        for n in names:
            self.stage(n)
        self._tables(text)
        return self.spark.sql(self._bind(text, [*names, *_names(text, TABLES)]))


def latest_chunks(run: Run) -> DataFrame:
    """``chunk_rows``; from a table, only chunks that were delivered more than once meet each other and are written."""
    if not run.lazy:
        return run._stated("chunk_rows")
    chunks = table(run.spark, run.source, "chunks").where("chunk_id IS NOT NULL AND file_path IS NOT NULL")
    repeated = cut(chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id"))
    if repeated.count() > REPEATED:
        return stored(run._stated("chunk_rows"))
    near = F.broadcast(repeated)
    run._view("chunks", chunks.join(near, "chunk_id", "left_semi"))
    latest = stored(run._stated("chunk_rows"))
    del run.done["chunks"]
    once = chunks.join(near, "chunk_id", "left_anti").withColumns({"language": F.lower("language"), "breadcrumbs": F.coalesce("breadcrumbs", F.array().cast("array<string>"))})
    return once.select(*latest.columns).unionByName(latest)

"""Hybrid hits that come about per query in arrays, against the stages in SQL."""

import pytest

from quern.functions.dialect import SPARK
from quern.operators.defined import CODES, Definitions, leaf
from quern.plans.catalog import BY_HITS, CATALOG
from quern.plans.runner import Run
from quern.search import CHUNKS

TEXTS = ["class TokenStore:\n  parse login", "def parse_config(x)\n read store", "x = TokenStore(parse_config(1))", "CREATE TABLE auth.TokenStore (id int)", "pub use auth::TokenStore;\nmod parse", "fn core::TokenStore<T>", "login state parse api", ""]
PATHS = ["src/tokenstore.py", "src/api/public.rs", "tests/test_parse.py", "docs/login_state.md", "lib/auth/mod.rs", "examples/read_config.py", "compat/token_store.d.ts"]


def _tables(spark, folder):
    rows = [(i, "r", PATHS[i % 7], 1 + i, 9 + i, [None, "Python", "go"][i % 3], f"{TEXTS[i % 8]} w{i % 11}", [("TokenStore", "class", 1), ("parse", "def", 2)] if i % 4 == 0 else None, ["login flow"] if i % 5 else None, None) for i in range(120)]
    spark.createDataFrame(rows, CHUNKS).repartition(3).write.parquet(f"{folder}/chunks.parquet")
    asked = [("TokenStore", None), ("auth::TokenStore", None), ("where is parse_config used in the login module", ["python"]), ("how does TokenStore parse login state", []), ("parser state api test file example", ["go", "cobol"]), ("public api docs source file", None), ("config.parse_config readConfig attribute", None), ("nowhere", None), ("  ", None), ("ns\\TokenStore", None), ("what is the login flow", ["cobol"])]
    schema = "query_id bigint, query_text string, search_mode string, top_k int, alpha double, filter_languages array<string>, issued_at timestamp"
    spark.createDataFrame([(q, t, "hybrid", 3 + q, None if q % 3 else 0.3, w, None) for q, (t, w) in enumerate(asked)], schema).write.parquet(f"{folder}/queries.parquet")
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("chunks", "queries")}


@pytest.mark.parametrize("name", ["hybrid_search", "pack_budget", "stem_boost", "path_intent_boost", "hybrid_explain"])
def test_no_candidate_is_a_row(spark, tmp_path, name):
    tables = _tables(spark, str(tmp_path))
    arrays, rows = Run(spark, str(tmp_path)), Run(spark, tables)
    got, want = (sorted(map(repr, run.sql(CATALOG[name](SPARK), name in BY_HITS).collect())) for run in (arrays, rows))
    assert got == want and got
    assert "coherent" in rows.done and not {"coherent", "definition_places", "path_overlaps", "file_terms"} & set(arrays.done)


def test_definitions():
    names = {"TokenStore": 1, "auth::TokenStore": 2, "parse": 3}
    one = lambda text, stem="a": Definitions(names).one(text, stem, list(names.items()))
    assert one("class TokenStore:") == [CODES] and one("  fn  core::TokenStore<T>") == [CODES]
    assert one("class auth::TokenStore {", "lib") == [CODES + 3, 2 * CODES + 2]
    assert one("create table x.tokenstore (") == [CODES] and one("class tokenstore") == [] == one("a TokenStore(parse(1))")
    assert one("pub use a::TokenStore;", "Mod") == [CODES + 3] and one("pub use a::TokenStore;") == []
    assert one("def " + " " * 500 + "parse(x)") == [3 * CODES] and one("def " + "a." * 300 + "parse") == [3 * CODES]
    assert [leaf(n) for n in ("a.b::c", "a\\b", "a->b", "a.b", "a")] == ["c", "b", "b", "b", "a"]

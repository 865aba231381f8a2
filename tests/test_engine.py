"""The engine's own operators: goldens, brute force and small trees."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import text
from quern.functions.dialect import DUCK, SPARK
from quern.operators import postings, sparse
from quern.plans.catalog import CATALOG
from quern.plans.registry import WITHOUT_TWIN, oracle_sql, queries
from quern.plans.runner import Run
from quern.search import _ASKED, CHUNKS, QUERIES, Index
from quern.sources import stores, tree
from quern.streaming.ingest import current, ingest


def test_every_query_has_a_twin():
    assert set(queries()) - WITHOUT_TWIN == set(oracle_sql()) and all(f(SPARK) and f(DUCK) for f in CATALOG.values())


def test_tokens(spark):
    def tokens(s):
        return spark.createDataFrame([(s,)], "s string").selectExpr(f"{text.tokens(SPARK, 's')} AS t").collect()[0].t

    assert tokens("getHTTPResponse parse_config2Value") [:4] == ["gethttpresponse", "get", "http", "response"]
    assert {"classes", "class", "classe", "resp"} <= {*tokens("classes response")}
    assert tokens(None) == [] and tokens("Vièle 12") == ["vi", "le"]


def _camel(token):
    out, word = [], token[:1]
    for a, b, c in zip(token, token[1:], [*token[2:], ""]):
        cut = (a.islower() and (b.isupper() or b.isdigit())) or (a.isdigit() and b.isalpha()) or (a.isupper() and b.isupper() and c.islower())
        if cut:
            out.append(word)
            word = ""
        word += b
    return [p.lower() for p in [*out, word] if p]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.from_regex(r"[a-zA-Z][a-zA-Z0-9]{0,12}", fullmatch=True), min_size=1, max_size=40))
def test_camel_parts_equal_a_state_machine(spark, words):
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{text.identifier_parts(SPARK, 'w')} AS p").collect()
    for r in got:
        assert r.p == list(dict.fromkeys([r.w.lower(), *_camel(r.w)]))


def corpus(spark):
    rows = [
        (1, "auth.py", "def authenticate(token):\n    return token == 'secret'", [("authenticate", "def", 1)]),
        (2, "auth.py", "def logout(user):\n    user.token = None", [("logout", "def", 10)]),
        (3, "users.py", "class UserStore:\n    def get(self, name):\n        return self.users[name]", [("UserStore", "class", 1)]),
        (4, "tests/test_auth.py", "def test_authenticate():\n    assert authenticate('secret')", []),
    ]
    return spark.createDataFrame([(i, "r", p, 1 if i != 2 else 10, 12, "python", c, s, [], None) for i, p, c, s in rows], CHUNKS)


def test_bm25_equals_brute_force(spark):
    index = Index(spark, corpus(spark))
    hits = index.search(["authenticate token", "  ", "logout"], mode="bm25", top_k=4)
    docs = {r.chunk_id: r for r in index.chunks.collect()}

    def pieces(r):
        stem = r.file_path.split("/")[-1].rsplit(".", 1)[0]
        return [r.content, *(x for s in r.symbols for x in (s.name, s.name, s.kind)), stem, stem, *r.file_path.split("/")[:-1]]

    def toks(s):
        return spark.createDataFrame([(s,)], "s string").selectExpr(f"{text.tokens(SPARK, 's')} AS t").collect()[0].t

    bags = {i: [t for p in pieces(r) for t in toks(p)] for i, r in docs.items()}
    mean = sum(map(len, bags.values())) / len(bags)
    score = {}
    for t in toks("authenticate token"):
        df = sum(t in b for b in bags.values())
        for i, b in bags.items():
            if t in b:
                tf = b.count(t)
                score[i] = score.get(i, 0) + math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(b) / mean))
    assert [(r.chunk_id, r.score) for r in hits if r.query_id == 0] == sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))
    assert hits[-1].query_id == 2 and hits[-1].chunk_id == 2
    assert index.search(["authenticate token", "  ", "logout"], mode="bm25", top_k=4) is hits


def _batch(spark):
    asked = [(1, "authenticate token", "hybrid", 2, None, [], [], None), (2, "the user self def", "hybrid", 3, 0.5, ["python"], [], None), (3, "token", "hybrid", 1, None, [], ["auth.py"], None), (4, "token", "hybrid", 1, None, ["cobol"], [], None), (5, "zzz", "hybrid", 1, None, [None], [], None)]
    more = spark.createDataFrame([(i, "r", f"lib/m{i % 7}.py", 1, 9, ["python", "rust", None][i % 3], f"def user_{i % 5}(token): return {i}", [("user", "def", 1)], [], None) for i in range(10, 700)], CHUNKS)
    return {"chunks": corpus(spark).unionByName(more), "queries": spark.createDataFrame(asked, QUERIES)}


def test_hits_of_a_batch_equal_the_statement_without_writing_the_index(spark, monkeypatch):
    monkeypatch.setattr(sparse, "PLACE", 100)
    tables = _batch(spark)
    run = Run(spark, tables, _ASKED)
    got = {n: sorted(tuple(r) for r in run.sql(f"SELECT query_id, chunk_id, score, rank FROM {n}").collect()) for n in ("bm25_hits", "dense_hits")}
    # Before, every posting was joined with its weight and written, and a row made of each query and chunk that share a term.
    assert not {"postings_built", "impacts", "chunk_vectors"} & set(run.done)
    stated = Run(spark, tables, _ASKED)
    assert got == {n: sorted(tuple(r) for r in stated._stated(n).collect()) for n in got}
    assert max(sum(r[0] == q for r in got["bm25_hits"]) for q in (1, 2)) == 200
    kept = Run(spark, tables, _ASKED, {n: stated.stage(n) for n in ("postings_built", "chunk_vectors")})
    assert got == {n: sorted(tuple(r) for r in kept.sql(f"SELECT query_id, chunk_id, score, rank FROM {n}").collect()) for n in got}


def test_hybrid_prefers_definitions_over_tests(spark):
    hits = Index(spark, corpus(spark)).search(["UserStore", "how does authenticate work"], top_k=3)
    first = {r.query_id: r.file_path for r in hits if r["rank"] == 1}
    assert first == {0: "users.py", 1: "auth.py"}
    assert Index(spark, corpus(spark)).search(["authenticate"], languages=["cobol"]) == []


def test_walk_and_read(spark, tmp_path):
    files = {
        "src/a.rs": "pub fn token_validation() {}\n", "src/__init__.py": "x = 1\n", "README.md": "# hi\n", ".gitignore": "*.log.py\n/skip/\n!keep.log.py\n", "b.log.py": "", "keep.log.py": "y = 2\n", "skip/c.py": "z\n",
        "deep/skip/d.py": "z = 1\n", "node_modules/e.js": "f()\n", ".hidden/f.py": "g\n", "Cargo.lock": "", "deep/.ignore": "**/gen\n", "deep/x/gen/h.py": "h\n", "big.py": "#" * 1_000_001, "a-b/i.py": "i = 1\n", "a/j.py": "\n\n",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe\xfd")
    root = str(tmp_path)
    assert tree.walk(root, tree.extensions(None)) == ["a/j.py", "a-b/i.py", "bad.rs", "deep/skip/d.py", "keep.log.py", "src/__init__.py", "src/a.rs"]
    assert "README.md" in tree.walk(root, tree.extensions(None, True)) and tree.walk(root, tree.extensions([" .RS"]), ["src"]) == ["bad.rs"]
    index = Index.from_tree(spark, root)
    assert index.chunks.count() == 5 and "valid UTF-8" in index.warnings.collect()[0].message
    assert index.search(["token_validation"], mode="bm25")[0].file_path == "src/a.rs"
    before = tree.signatures(spark, root, ["src/a.rs", "bad.rs"])
    assert stores.signature_changes(before, before).count() == 0
    assert {tuple(r) for r in stores.signature_changes(before, tree.signatures(spark, root, ["bad.rs", "src/__init__.py"])).collect()} == {("src/a.rs", "removed"), ("src/__init__.py", "added")}
    assert tree.is_git_url("git@host:a/b") and tree.is_git_url("https://x/y") and not tree.is_git_url("/a/b")


@settings(max_examples=10, deadline=None)
@given(n=st.integers(1, 40), size=st.integers(2, 9), overlap=st.integers(0, 12))
def test_windows_equal_the_loop(spark, n, size, overlap):
    lines = [f"l{i}" for i in range(n)]
    got = tree.line_windows(spark.createDataFrame([("f", None, "\n".join(lines) + "\n")], "file_path string, language string, content string"), size, overlap).orderBy("ordinal").collect()
    want, start = [], 0
    while True:
        end = min(start + size, n)
        want.append((start + 1, end, "\n".join(lines[start:end])))
        if end == n:
            break
        start = end - min(overlap, size - 1)
    assert [(r.start_line, r.end_line, r.content) for r in got] == want


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "index")
    stores.save_tables({"t": spark.range(3)}, folder)
    stores.save_tables({"t": spark.range(4)}, folder)
    assert stores.load_tables(spark, folder)["t"].count() == 4 and stores.load_tables(spark, folder + "x") is None
    assert stores.folder_summary(str(tmp_path))["entries"] == 1 and not stores.clean(folder) and stores.clean(folder, force=True)
    path = str(tmp_path / "feedback.jsonl")
    assert stores.list_feedback(spark, path, 3) == ([], 0)
    cases = [stores.append_feedback(path, f"q{i}", "a.py") for i in range(4)]
    rows, total = stores.list_feedback(spark, path, 2)
    assert total == 4 and len(rows) == 2 and cases[0]["query"] == "q0"
    profiles = stores.Profiles(str(tmp_path / "p.json"))
    profiles.save("b", {"limit": 3})
    profiles.save("a", {})
    assert list(profiles.all()) == ["a", "b"] and profiles.delete("a") and not profiles.delete("a")
    assert stores.resolve({"limit": 5, "mode": "hybrid"}, profiles.all()["b"], {"mode": None, "limit": 9}) == {"limit": 9, "mode": "hybrid"}


def test_ingest_keeps_the_latest(spark, tmp_path):
    rows = spark.sql("SELECT 1L chunk_id, 'a' content, timestamp'2025-01-01' indexed_at UNION ALL SELECT 1L, 'b', timestamp'2025-01-02' UNION ALL SELECT null, 'c', null")
    rows.write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.content for r in current(spark, str(tmp_path / "out")).collect()] == ["b"]
    # A chunk that comes again, later or with the same time, takes the place of what a batch before it brought.
    spark.sql("SELECT 1L chunk_id, 'd' content, timestamp'2025-01-02' indexed_at UNION ALL SELECT 2L, 'e', null").write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.content for r in current(spark, str(tmp_path / "out")).collect()) == ["d", "e"]


def test_names_are_words():
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in queries())


def test_hits_of_both_retrievers_come_about_together(spark, tmp_path):
    words = ["token", "parse", "login", "store", "read"]
    rows = [(i, "r", f"d{i % 3}/f{i % 7}.py", 1, 9, "Python" if i % 2 else "go", " ".join(words[: 1 + i % 5]) + f" x{i % 11}", [("Parse", "def", 1)] if i % 4 == 0 else None, ["a", "b"], None) for i in range(90)]
    spark.createDataFrame([*rows, *rows[:9]], CHUNKS).repartition(3).write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [(1, "parse login", None), (2, "token x3", ["python"]), (3, "  ", None), (4, "nowhere", None), (5, "read store", ["cobol"])]
    spark.createDataFrame([(q, t, "hybrid", 1, None, w, None) for q, t, w in asked], "query_id bigint, query_text string, search_mode string, top_k int, alpha double, filter_languages array<string>, issued_at timestamp").write.parquet(f"{tmp_path}/queries.parquet")
    together, apart = Run(spark, str(tmp_path)), Run(spark, str(tmp_path))
    got = {tuple(r) for r in together.sql(CATALOG["rrf_fuse"](SPARK)).collect()}
    assert "both_hits" in together.done
    for name in ("bm25_hits", "dense_hits"):
        hits = [sorted(tuple(r) for r in run.stage(name).select("query_id", "chunk_id", "score", "rank").collect()) for run in (together, apart)]
        assert hits[0] == hits[1] and hits[0]
    assert "both_hits" not in apart.done and got == {tuple(r) for r in apart.sql(CATALOG["rrf_fuse"](SPARK)).collect()}
    assert together.stage("chunk_rows").count() == 90
    asked_terms, every = ({r.term for r in run.stage("file_terms").select("term").distinct().collect()} for run in (together, Run(spark, str(tmp_path))))
    assert asked_terms < every


def test_packed_rows_come_back_whole():
    v = np.array([[0, -127, 3], [128, 0, -70_000], [1, 2, 127]])
    assert (postings.unpacked_vectors(postings.packed_vectors(v), 3) == v).all()
    ids, units = np.array([7, 2**62, -5]), np.array([3.0, -1_000_000.0, 12_345_678.0])
    got = sparse._unpacked_hits(sparse._packed_hits(ids, units))
    assert dict(zip(*map(np.ndarray.tolist, got))) == {7: 3, 2**62: -1_000_000, -5: 12_345_678}
    assert [len(x) for x in sparse._unpacked_hits(sparse._packed_hits(sparse.NONE, sparse.NONE))] == [0, 0]

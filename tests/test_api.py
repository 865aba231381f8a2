"""The index over a tree: chunking, symbols, filters, lookups, packing, storing, encoders; and rules by their own definitions."""

import json
import re
import struct
import subprocess

import numpy as np
import pytest

from quern.functions import classify, text
from quern.functions.dialect import SPARK
from quern.operators import encoders
from quern.plans.runner import Run
from quern.search import CHUNKS, QUERIES, Index
from quern.sources import chunking, render, tree


def covers(source, chunks):
    assert "".join(c[2] for c in chunks) == source
    at = 0
    for a, b, content in chunks:
        assert a == source[:at].count("\n") + 1 and b == source[: at + len(content) - 1].count("\n") + 1
        at += len(content)


def test_code_chunks_follow_the_structure():
    short = "import os\n\n\ndef f():\n    return 1\n"
    assert chunking.code_chunks(short, "python") == [(1, 5, short)]
    defs = "".join(f"def function_number_{i}():\n    return {i}\n\n\n" for i in range(80))
    chunks = chunking.code_chunks(defs, "python")
    covers(defs, chunks)
    # The lines between definitions are not counted.
    assert all(c[2].startswith("def ") and len(c[2]) <= 1600 for c in chunks) and len(chunks) >= 2
    nested = "class A:\n" + "".join(f"    def m{i}(self):\n        x = 'something to fill the line {i}'\n        return x\n\n" for i in range(60))
    covers(nested, chunking.code_chunks(nested, "python"))
    assert all(re.match(r"class A|    def ", c[2]) for c in chunking.code_chunks(nested, "python"))
    braces = "".join(f"export function f{i}(a) {{\n  if (a) {{\n    return {i};\n  }}\n}}\n\n" for i in range(60))
    covers(braces, chunking.code_chunks(braces, "typescript"))
    assert all(c[2].startswith("export function") for c in chunking.code_chunks(braces, "typescript"))
    literal = 'X = "' + "a" * 2500 + '"\n'
    covers(literal, chunking.code_chunks(literal, "python"))
    assert max(len(c[2]) for c in chunking.code_chunks(literal, "python")) <= 1501
    broken = "def f(:\n" + "    x = 1\n" * 300
    covers(broken, chunking.code_chunks(broken, "python"))
    assert chunking.code_chunks(" \n", "python") == chunking.code_chunks("x", "markdown") == chunking.code_chunks("x", None) == []


def test_groups_are_merged_below_the_size():
    spans = [[(i * 10, i * 10 + 10)] for i in range(7)]
    groups, sizes = chunking.merged(spans, [10] * 7, 31)
    assert sizes == [30, 30, 10] and groups[0] == [(0, 10), (10, 20), (20, 30)]
    # A sum that reaches the size is too much; the last group of those that would fit stays alone.
    assert chunking.merged(spans[:3], [10] * 3, 30)[1] == [20, 10] and chunking.merged(spans[:2], [5, 5], 100)[1] == [5, 5] and chunking.merged(spans[:1], [99], 10)[1] == [99]
    assert chunking.covering([[(3, 5)], [(9, 12), (12, 14)]], 20) == [(0, 9), (9, 20)] and chunking.slices(0, 7, 3) == [(0, 3), (3, 6), (6, 7)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    files = {
        "src/auth.py": "import os\n\n\nclass SessionStore:\n    def open(self, token):\n        return token\n\n\ndef authenticate(token):\n    return SessionStore().open(token)\n", "src/users.py": "class UserStore:\n    def get(self, name):\n        return self.users[name]\n",
        "src/deep/helper.rs": "pub fn helper() -> u32 {\n    1\n}\n", "tests/test_auth.py": "from src.auth import authenticate\n\n\ndef test_authenticate():\n    assert authenticate('x')\n", "README.md": "# Notes\n\nHow to authenticate.\n",
        "src/long.py": "".join(f"def step_{i}(value):\n    result = value * {i}\n    return result\n\n\n" for i in range(80)),
    }
    for name, body in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(body)
    return top


def test_index_of_a_tree(spark, root, tmp_path):
    folder = str(tmp_path / "index")
    index = Index.from_tree(spark, str(root), folder=folder)
    rows = index.chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows))) and [r.file_path for r in rows] == sorted((r.file_path for r in rows), key=lambda p: p.split("/"))
    auth = next(r for r in rows if r.file_path == "src/auth.py")
    # `def f(x)` and `return f(x)` have the form of a function in C and are taken as one.
    assert [(s.name, s.kind, s.line) for s in auth.symbols] == [("SessionStore", "class", 4), ("open", "function", 5), ("authenticate", "function", 9), ("SessionStore", "function", 10)]
    assert auth.breadcrumbs == ["class SessionStore", "function open", "function authenticate", "function SessionStore"]
    assert index.search(["SessionStore"], top_k=3)[0].file_path == "src/auth.py" and index.is_fresh()
    assert index.semantic_loaded
    # Filters: paths are normalised, languages and paths both hold, nothing matches nothing.
    assert {h.file_path for h in index.search(["authenticate"], paths=["./tests//test_auth.py"])} == {"tests/test_auth.py"}
    assert {h.file_path for h in index.search(["helper"], languages=["rust"])} == {"src/deep/helper.rs"} and index.search(["helper"], languages=["rust"], paths=["src/auth.py"]) == []
    told = index.search_with("authenticate", languages=["cobol"], paths=["./src/auth.py", "no.py"])
    assert told["hits"] == [] and not told["truncated"] and any("Did you mean 'src/auth.py'" in w for w in told["warnings"]) and any("cobol" in w and "python, rust" in w for w in told["warnings"]) and any("'no.py'." in w for w in told["warnings"])
    assert index.search_with("authenticate", top_k=1)["truncated"]
    explained = index.search(["authenticate"], top_k=2, explain=True)
    assert explained[0].alpha == 0.55 and explained[0].final_score == explained[0].score and explained[0].bm25_rank >= 1
    # Lookups.
    assert index.chunk_at("src/auth.py", 5).chunk_id == auth.chunk_id and index.chunk_at("src/auth.py", 99) is None
    assert [r.start_line for r in index.chunks_for_file("src/long.py")][0] == 1 and index.chunks_for_file("none.py") == []
    assert index.indexed_files(2) == {"files": ["src/auth.py", "src/deep/helper.rs"], "total": 5, "truncated": True}
    stats = index.stats()
    assert stats["indexed_files"] == 5 and stats["total_chunks"] == len(rows) and stats["languages"]["rust"] == 1
    related = index.find_related("src/auth.py", 1, 2)
    assert 1 <= len(related) <= 2 and all(h.chunk_id != auth.chunk_id and h.file_path.endswith(".py") for h in related) and index.find_related("none.py", 1) == []
    # A pack starts with the best hit, adds what belongs to it, and stops at the budget.
    packed = index.pack(["step_79"], tokens=700)
    assert packed[0].kind == "primary" and {"file_header", "neighbor"} <= {p.kind for p in packed} and sum(p.taken for p in packed) <= 2800 and all(len(p.content.encode()) == p.taken for p in packed)
    # A later session finds the stored index; a changed file makes it stale.
    again = Index.from_tree(spark, str(root), folder=folder)
    assert again.built and [h.chunk_id for h in again.search(["SessionStore"], top_k=3)] == [h.chunk_id for h in index.search(["SessionStore"], top_k=3)]
    (root / "src/users.py").write_text("class UserStore:\n    pass\n")
    assert not again.is_fresh() and Index.from_tree(spark, str(root), folder=folder).built == {}
    with pytest.raises(ValueError):
        index.search(["x"], mode="other")
    with pytest.raises(NotADirectoryError):
        Index.from_tree(spark, str(root / "none"))
    with pytest.raises(ValueError):
        Index.from_git(spark, "https://host/a/b", offline=True)


def test_ignore_rules_from_outside_the_root(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    top = tmp_path / "repo"
    for name in ("a.py", "excluded.py", "above.py", "global.py", "kept.py"):
        (top / "pkg").mkdir(parents=True, exist_ok=True)
        (top / "pkg" / name).write_text("x = 1\n")
    subprocess.run(["git", "init", "-q", str(top)], check=True)
    (top / ".git" / "info").mkdir(exist_ok=True)
    (top / ".git" / "info" / "exclude").write_text("excluded.py\nkept.py\n")
    (top / ".gitignore").write_text("/pkg/above.py\n!kept.py\n")
    (tmp_path / "config" / "git").mkdir(parents=True)
    (tmp_path / "config" / "git" / "ignore").write_text("global.py\n")
    assert tree.walk(str(top / "pkg"), tree.extensions(None)) == ["a.py", "kept.py"]
    assert tree.walk(str(top), tree.extensions(None)) == ["pkg/a.py", "pkg/kept.py"]
    assert tree.resolve_source(str(top))[0] == "path" and tree.resolve_source("git@host:a/b", "main") == ("git", "git@host:a/b", "git:git@host:a/b@main")


def model(folder, names, vectors, **more):
    tensors = {"embeddings": np.array(vectors, dtype=np.float32)} | more
    header, data = {}, b""
    for name, t in tensors.items():
        raw = t.tobytes()
        header[name] = {"dtype": {"f4": "F32", "f2": "F16", "i8": "I64"}[t.dtype.str[1:]], "shape": list(t.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(header).encode()
    (folder / "model.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + data)
    (folder / "tokenizer.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {n: i for i, n in enumerate(names)}, "unk_token": names[0]}}))
    (folder / "config.json").write_text('{"normalize": false}')


def test_encoders(spark, root, tmp_path):
    model(tmp_path, ["[UNK]", "token", "store", "user"], [[9, 9], [1, 0], [0, 2]], mapping=np.array([0, 1, 2, 1]), weights=np.array([1, 1, 0.5, 3], dtype=np.float16))
    e = encoders.StaticEncoder(str(tmp_path))
    got = e.encode(["Token store", "user nothing", "nothing", ""])
    assert got.tolist() == [[0.5, 0.5], [3, 0], [0, 0], [0, 0]] and e.dim == 2
    assert encoders.model_status(str(tmp_path))["fingerprint"] == e.fingerprint and not encoders.model_status(str(tmp_path / "x"))["available"]
    with pytest.raises(FileNotFoundError):
        encoders.StaticEncoder(str(tmp_path / "x"))
    # The hashing encoder is the engine's own: the same ranking from its vectors as from the tables.
    own, given = Index.from_tree(spark, str(root)), Index.from_tree(spark, str(root), encoder=encoders.HashingEncoder())
    assert not given.semantic_loaded and given.warm_semantic().semantic_loaded
    pick = lambda i: [(h.chunk_id, h.score) for h in i.search(["open a session store", "helper"], "semantic", 4)]
    assert pick(own) == pick(given)
    words = ["getHTTPResponse parse_config2Value", "HTTP2Server x86 __init__ classes ies", "deserializing auth"]
    table = spark.createDataFrame([(w,) for w in words], "s string").selectExpr("s", f"{text.tokens(SPARK, 's')} AS t")
    assert {r.s: sorted(r.t) for r in table.collect()} == {w: sorted(encoders.tokenize(w)) for w in words}


def test_text_output(spark):
    row = spark.sql("SELECT 'a.py' AS file_path, 1 AS start_line, 2 AS end_line, 0.5D AS score, 'x ```` y' AS content").collect()[0]
    assert render.results("Search results", [row], "bm25") == "Search results\n\n## 1. a.py:1-2  [score=0.500, source=bm25]\n`````\nx ```` y\n`````\n"
    assert render.compact([row]) == "a.py:1-2\t0.500" and json.loads(render.json_lines([row]))["end_line"] == 2
    assert render.estimate_tokens("  ") == 1 and render.languages({"b": 2, "a": 1}) == "a 1, b 2" and render.truncate("abc", 2) == "ab"


def test_names_of_test_files():
    yes = ["test_a.py", "x/a_test.go", "ATest.java", "ATests.cs", "AppTest.php", "a_spec.rb", "a.test.tsx", "a.spec.js", "ASpec.kt", "ASuite.scala", "test_helpers.zig", "test_helper_x.py", "test_a.cpp"]
    no = ["atest.java", "contest.py", "test_a.rs", "a.tests.js", "ASuite.java", "spec.rb", "x_test/a.py"]
    assert all(re.search(classify.TEST_FILE, p) for p in yes) and not any(re.search(classify.TEST_FILE, p) for p in no)


# ---- boosts by their own definitions -------------------------------------------------------------------------------


def staged(spark, chunks, queries, name):
    table = spark.createDataFrame([(i, "r", p, a, a + c.count("\n"), lang, c, s, [], None) for i, (p, a, lang, c, s) in enumerate(chunks)], CHUNKS)
    asked = spark.createDataFrame([(i, q, "hybrid", 10, None, [], [], None) for i, q in enumerate(queries)], QUERIES)
    return Run(spark, {"chunks": table, "queries": asked}, {"asked_queries": lambda d: "SELECT * FROM queries"}).stage(name)


def test_definitions_and_reexports(spark):
    chunks = [
        ("src/token_manager.py", 1, "python", "class TokenManager:\n    pass\n", [("TokenManager", "class", 1)]), ("src/other.py", 1, "python", "class TokenManager:\n    pass\n", [("TokenManager", "class", 1)]),
        ("src/lib.rs", 1, "rust", "mod a;\npub use a::TokenManager;\n", []), ("src/user.rs", 1, "rust", "use a::TokenManager;\n", []), ("db/schema.sql", 1, "sql", "create table TokenManager (\n id int);\n", []),
        ("src/say.py", 1, "python", "# the class TokenManagers are others\nx = TokenManager()\n", []),
    ]
    got = {(r.query_id, r.chunk_id): float(r.tier) for r in staged(spark, chunks, ["TokenManager", "auth::TokenManager", "how does TokenManager work"], "definition_tiers").collect()}
    # A definition counts 3 (a question's 1.5), half as much again in the file that is named after it; SQL in any case, a public re-export too.
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 0): 4.5, (0, 1): 3.0, (0, 2): 3.0, (0, 4): 3.0}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0): 4.5, (1, 1): 3.0, (1, 2): 3.0, (1, 4): 3.0}
    assert got[2, 0] == 2.25 and got[2, 1] == 1.5 and (2, 3) not in got and (2, 5) not in got
    named = {(r.query_id, r.name) for r in staged(spark, chunks, ["a::b->c.Leaf", "use the TokenManager attribute", "x->y"], "query_names").collect()}
    assert named >= {(0, "b->c.Leaf"), (1, "TokenManagerAttribute"), (2, "y")} and (1, "TokenManager") not in named


def test_symbol_candidates_by_place(spark):
    chunks = [(f"f{i}.py", 1, "python", "x", [("Widget", "class", 1)]) for i in range(70)] + [("g.py", 1, "python", "x", [("widget", "def", 1), ("gear", "def", 2)])]
    got = {r.chunk_id: float(r.part) for r in staged(spark, chunks, ["Widget", "nothing here"], "symbol_candidates").collect()}
    assert len(got) == 64 and all(abs(got[i] - 1 / (61 + i)) < 1e-9 for i in range(64))


# ---- evaluation ----------------------------------------------------------------------------------------------------


def test_tasks_from_files(spark, tmp_path):
    from quern.sources import tasks

    (tmp_path / "annotations").mkdir()
    (tmp_path / "repos.json").write_text(json.dumps([{"name": "a", "language": "python", "url": "u", "revision": "r"}, {"name": "b", "language": "go", "url": "v", "revision": "s", "benchmark_root": "src"}]))
    (tmp_path / "annotations" / "lib.core.json").write_text(json.dumps([{"query": "TokenStore", "relevant": ["src/a.py", {"path": "b.py", "start_line": "3", "end_line": 9}], "secondary": ["c.py"]}, {"query": "how is it", "relevant": [], "category": "x", "repo": "other"}]))
    got = {r.query: r for r in tasks.load_tasks(spark, str(tmp_path / "annotations")).collect()}
    assert [tuple(t) for t in got["TokenStore"].targets] == [("src/a.py", None, None), ("b.py", 3, 9), ("c.py", None, None)] and (got["TokenStore"].repo, got["TokenStore"].category) == ("lib.core", "symbol")
    assert (got["how is it"].repo, got["how is it"].category, got["how is it"].targets) == ("other", "x", []) and tasks.load_specs(spark, str(tmp_path / "repos.json")).where("benchmark_root is null").count() == 1
    hits = spark.sql("SELECT 'x/b.py' file_path, 1 start_line, 2 end_line UNION ALL SELECT 'x/b.py', 9, 20 UNION ALL SELECT 'c.py', 1, 1 UNION ALL SELECT 'xc.py', 1, 1").collect()
    targets = got["TokenStore"].targets
    assert tasks.marked(hits, targets) == [False, True, True, False] and [tasks.target_rank(hits, t) for t in targets] == [None, 2, 3] and [tasks.label(t) for t in targets] == ["src/a.py", "b.py:3-9", "c.py"]


def test_cases_and_command_line(spark, root, tmp_path):
    from quern.__main__ import run
    from quern.sources import stores

    index = Index.from_tree(spark, str(root))
    cases = [("SessionStore", "src/auth.py"), ("helper", "src/deep/helper.rs:1"), ("helper", "none.rs")]
    scored = index.evaluate(cases)
    assert scored["hits"] == 2 and abs(scored["hit_rate"] - 2 / 3) < 1e-9 and abs(scored["ndcg"] - 2 / 3) < 1e-9 and index.evaluate([])["ndcg"] == 0
    assert index.tune([])["best"] is None
    for q, expected in cases[:2]:
        stores.append_feedback(str(tmp_path / "cases.jsonl"), q, expected)
    stores.Profiles(str(tmp_path / "p.json")).save("short", {"limit": 1, "mode": "bm25"})
    out = run(["search", str(root), "SessionStore", "--profiles", str(tmp_path / "p.json"), "--profile", "short", "--format", "compact"], spark)
    assert out.startswith("src/auth.py:1-") and len(out.splitlines()) == 1
    assert json.loads(run(["eval", str(root), "--cases", str(tmp_path / "cases.jsonl"), "--mode", "bm25"], spark))["hits"] == 2
    assert run(["status", str(root)], spark).startswith("5 files") and run(["list-files", str(root), "--limit", "1"], spark) == "src/auth.py\n... 5 files in all"
    assert "class SessionStore" in run(["get", str(root), "src/auth.py:5"], spark) and run(["search", str(root), "x", "--language", "cobol", "--mode", "bm25"], spark).endswith("No results found.")

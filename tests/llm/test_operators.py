"""Each operator against brute force or a round trip, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, distinctive, fusion, near_dup, neighbors, packing, repetition, source_files, splitting, term_counts
from quern.llm.blocks import block_starts

CHUNK = "chunk_id bigint, repo string, file_path string, ordinal int, start_line bigint, end_line bigint, language string, content string, symbols array<struct<name:string,kind:string,line:bigint>>, breadcrumbs array<string>, indexed_at timestamp"


def chunk(i, path="r/a.py", content="x = 1\n", start=1, language="python", **more):
    return (i, path.split("/")[0], path, 0, start, start + content.count("\n") if content else start, language, content, more.get("symbols"), more.get("breadcrumbs"), None)


def rows(df):
    return sorted(map(tuple, df.collect()))


# ---- 1 -------------------------------------------------------------------------------------------------------------


def test_labels_follow_signs_and_trees(spark):
    code = "def f(a):\n    return a\n\n\nclass B:\n    pass\n"
    generated = "# Code generated by maker v1.2. DO NOT EDIT.\n" + code
    blob = "T = (\n" + "    0x12, 0x34, 0x56, 0x78, 0x9a, 0xbc,\n" * 40 + ")\n"
    packed = "".join(f"function a{i}(b){{return b.c({i})}}" for i in range(60))
    alike = "\n\n".join(f"func (x *T) Get{w}() int {{\n\treturn *x.{w}\n}}" for w in "abcdefgh")
    files = {
        "r/p/src/a.py": code, "r/p/src/gen.py": generated, "r/p/src/t.py": blob, "r/p/static/m.js": packed, "r/p/src/x.go": alike, "r/p/third_party/lib/deep/f.py": code,
        "r/p/vendor/lib/g.py": code, "r/p/src/vendor/own.py": code, "r/p/src/vendor_portal/own.py": code, "r/p/src/banner.py": "# Writes the DO NOT EDIT banner for the templates.\n" + code, "top.py": code,
        "r/p/src/empty.py": "", "r/p/src/none.py": None,
    }
    table = spark.createDataFrame([chunk(i, p, t) for i, (p, t) in enumerate(files.items())] * 2, CHUNK).withColumn("label", F.lit("clash"))
    got = {r.file_path: r.label for r in source_files.label_files(table).collect()}
    assert len(got) == len(files)
    hand = ["r/p/src/a.py", "r/p/src/vendor/own.py", "r/p/src/vendor_portal/own.py", "r/p/src/banner.py", "top.py", "r/p/src/empty.py", "r/p/src/none.py"]
    assert [got[p] for p in hand] == ["handwritten"] * len(hand)
    assert [got[p] for p in ("r/p/src/gen.py", "r/p/src/x.go", "r/p/src/t.py", "r/p/static/m.js", "r/p/third_party/lib/deep/f.py", "r/p/vendor/lib/g.py")] == ["generated", "generated", "blob", "minified", "vendored", "vendored"]
    assert source_files.label_files(table.limit(0)).count() == 0


def test_weights_follow_the_collection(spark):
    # A sign that only files of one label show gains, one that handwritten files show as often does not.
    plain = [f"x{i}" for i in range(5)]
    made = lambda n, label, **signs: [("f", *(s in signs for s in source_files.SIGNS), *(0.0 if i == label else -9.0 for i in range(5))) for _ in range(n)]
    data = made(900, 0) + made(30, 0, s_bundled=1) + made(60, 2, s_packed=1, s_minified_name=1, s_bundled=1) + made(40, 2, s_minified_name=1)
    schema = "file_path string, " + ", ".join(f"{s} boolean" for s in source_files.SIGNS) + ", " + ", ".join(f"{x} double" for x in plain)
    weights = dict(zip(source_files.SIGNS, source_files.fitted(spark.createDataFrame(data, schema))[2][1]))
    assert weights["s_minified_name"] > 6 and weights["s_packed"] >= 9 and weights["s_bundled"] < weights["s_minified_name"] and weights["s_vendored"] < 3
    assert source_files.fitted(spark.createDataFrame([], schema))[0] == (0.0, [0.0] * len(source_files.SIGNS))


def test_signs_count_wherever_they_stand(spark):
    code = "def f(a):\n" + "".join(f"    a = a.{'x' * i}(a)\n" for i in range(1, 40)) + "    return a\n"
    banner = "# <auto-generated>\n#     maker wrote this file; changes are lost on the next run.\n# </auto-generated>"
    template = 'BANNER = """\n' + "# Code generated by {tool}. DO NOT EDIT.\n" + '"""\n'
    table = [
        chunk(1, "r/p/src/tail.py", code + banner), chunk(2, "r/p/src/last.py", code), chunk(3, "r/p/src/last.py", code + banner, start=49), chunk(4, "r/p/src/maker.py", code + template + code),
        chunk(5, "r/p/src/docs.py", 'end of a docstring\n"""\n' + code + banner, start=49), chunk(6, "r/p/src/copy.py", code + "# Copied verbatim from maker, send fixes upstream.\n"), *(chunk(10 + i, f"r/p/src/own{i}.py", code) for i in range(4)),
    ]
    got = {r.file_path.rsplit("/")[-1]: r.label for r in source_files.label_files(spark.createDataFrame(table, CHUNK)).collect()}
    assert {n: x for n, x in got.items() if not n.startswith("own")} == {"tail.py": "generated", "last.py": "generated", "maker.py": "handwritten", "docs.py": "generated", "copy.py": "vendored"}


# ---- 2 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("language", "text", "lines"),
    [
        ("python", "import a\n\n\n@deco(\n    1,\n)\n# why\ndef f():\n    x = 1\n\n    return x\n\nprint(1)\n\nX = 1\n", [3, 14]),
        ("python", 'def f():\n    """Doc\n\ndef no():\n    """\n\nclass C:\n    pass\n', [6]),
        ("typescript", "import a\n\nconst t = `\nclass X {}\n\nclass Y {}\n`;\n\n/**\n * c\n\n * d\n */\nexport class Z {\n\n  m() {}\n}\n", [2, 8]),
        ("go", "package a\n\nimport \"b\"\n\n// d\nfunc F() {\n\n\tx := 1\n}\n\ntype T struct{}\n", [4, 10]),
        ("rust", "use a;\n\n#[test]\nfn f() {\n  let s = r#\"\n\nfn no() {}\n\"#;\n}\n\nimpl A {}\n", [2, 10]),
        ("sql", "-- a\nCREATE TABLE t (\n  a INT\n);\n\nSELECT 1\n\nFROM t;\n\n-- alone\n\nINSERT INTO t VALUES (1);\n", [5, 11]),
        ("markdown", "# A\n\ntext\n\n```sh\n\n# no\n```\n\n## B\n", [9]),
        ("bash", "set -e\n\nf() {\n  cat <<EOF\n\ng() {\nEOF\n}\n\nls\n\nX=1\n", [2, 11]),
        ("json", '{\n\n"a": 1}\n', []),
        (None, "def f():\n\ndef g():\n", []),
    ],
)
def test_block_starts(language, text, lines):
    assert block_starts(text, language) == lines


def test_pieces_fit_and_join(spark):
    rng = random.Random(3)
    texts = ["\n".join(" " * rng.randint(0, 4) + "w" * rng.randint(0, 60) for _ in range(rng.randint(1, 60))) for _ in range(12)] + ["z" * 1000, "a;" * 700, "", None, "é" * 101, "x\r\n" * 200, "\n" * 300]
    table = spark.createDataFrame([chunk(i, f"r/{i}.py", t, start=7) for i, t in enumerate(texts)] * 2, CHUNK).withColumn("piece", F.lit(1))
    pieces = splitting.split_chunks(table, limit=100, overlap=2).collect()
    by = {}
    for p in sorted(pieces, key=lambda p: (p.chunk_id, p.piece)):
        assert len(p.content) <= 100 and p.end_line >= p.start_line
        by[p.chunk_id] = by.get(p.chunk_id, "") + "\n".join(p.content.split("\n")[p.repeated_lines :])
        if len(max(texts[p.chunk_id].split("\n"), key=len)) < 100:
            whole = texts[p.chunk_id].split("\n")[p.start_line - 7 : p.end_line - 6]
            assert p.content in ("\n".join(whole), "\n".join(whole) + "\n")
    assert by == {i: t for i, t in enumerate(texts) if t and len(t) > 100}
    assert splitting.split_chunks(table.limit(0)).count() == 0


def test_squared_successors_equal_a_walk():
    rng = random.Random(21)
    texts = ["\n".join("w" * rng.choice((0, 3, 9, 400)) for _ in range(rng.randint(1, 200))) for _ in range(30)]
    tables = [np.array(splitting.boundaries_of(t, [], 60, 3)) for t in texts]
    base = np.cumsum([0, *(len(t) + 61 for t in texts)])
    flat, which = np.concatenate(tables), np.repeat(np.arange(len(texts)), [len(t) for t in tables])
    first = np.flatnonzero(np.diff(which, prepend=-1))
    following = splitting.successors(base[which], *flat[:, [0, 1, 3]].T, 60)
    walked = set()
    for i in first.tolist():
        while i not in walked:
            walked.add(i)
            assert which[following[i]] == which[i] and flat[following[i], 0] - flat[i, 3] <= 60
            i = int(following[i])
    assert set(np.flatnonzero(splitting.cuts(following, first)).tolist()) == walked


def test_block_starts_come_with_the_pieces(spark):
    text = "import a\n\n" + "".join(f"def f{i}():\n    return {i}\n\n" for i in range(200))
    late = spark.sql("SELECT timestamp'2025-01-02' AS t").collect()[0].t
    table = [chunk(1, content=text, start=11), (*chunk(1, content=text + "X = 1\n", start=11)[:-1], late), chunk(2, content="x\n" * 10), chunk(3, content=None)]
    split = splitting.pieces_by_chunk(spark.createDataFrame(table, CHUNK), contents=False)
    assert rows(splitting.block_lines(split)) == [(1, 13 + 3 * i) for i in range(201)] and split.count() == 1


def test_breadcrumbs_go_with_their_lines(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    table = spark.createDataFrame([chunk(1, content=text, symbols=[("a", "def", 1), ("b", "def", 39)], breadcrumbs=["def a", "def b", "module m"])], CHUNK)
    pieces = sorted(splitting.split_chunks(table, limit=120, overlap=0).collect(), key=lambda p: p.piece)
    assert pieces[0].breadcrumbs == ["def a", "module m"] and pieces[-1].breadcrumbs == ["def b", "module m"] and all("module m" in p.breadcrumbs for p in pieces)


# ---- 3 -------------------------------------------------------------------------------------------------------------


def test_tail_is_exact():
    def exact(k, n, kk, nn):
        return sum(math.comb(kk, i) * math.comb(nn - kk, n - i) for i in range(k, min(n, kk) + 1) if 0 <= n - i <= nn - kk) / math.comb(nn, n)

    cases = [(k, n, kk, nn) for nn in (30, 400) for kk in (1, 7, 25) for n in (3, 20) for k in range(1, min(n, kk) + 1)]
    got = distinctive.upper_tail_log10(*map(np.array, zip(*cases)))
    assert np.allclose(10.0**got, [exact(*c) for c in cases], rtol=1e-9)
    x = np.array([0.5, 1, 2, 3.5, 10, 1e6])
    assert np.allclose(distinctive.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_rare_shared_terms_lead(spark):
    posts = [("The", c, 5) for c in range(20)] + [("zeta", 3, 6), (" zeta ", 3, 6), ("zeta", 4, 1), (None, 3, 9), ("", 3, 9), ("solo", 3, None)]
    p = spark.createDataFrame(posts, "term string, chunk_id bigint, tf int").withColumn("score", F.lit(1))
    d = spark.createDataFrame([(c, 1, 12 if c else None) for c in range(20)], "chunk_id bigint, index_id bigint, doc_len bigint")
    s = spark.createDataFrame([(1, "x", 20, 6.0)], "index_id bigint, source_id string, doc_count bigint, avg_doc_len double")
    scores = distinctive.term_scores(p, d, s)
    assert scores.where("chunk_id = 3").count() == 3
    best = {r.chunk_id: r.term for r in distinctive.most_distinctive(scores).collect()}
    assert best[3] == "zeta" and best[7] == "the"
    only = distinctive.term_scores(p, d, s, only=spark.createDataFrame([(3,), (3,), (None,), (99,)], "chunk_id bigint"))
    assert rows(only) == rows(scores.where("chunk_id = 3"))
    assert distinctive.term_scores(p.limit(0), d.limit(0), s.limit(0)).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------------


def test_fusion_ignores_scale(spark):
    ev = [(1, c, "bm25", s, r) for c, s, r in ((1, 900000.0, 1), (2, 12.0, 2), (3, 11.0, 3), (4, 1.0, 4), (5, None, 5), (6, float("nan"), None))] + [(1, c, "semantic", s, r) for c, s, r in ((2, 0.9, 1), (7, 0.5, 2), (8, 0.4, 3), (1, -0.2, 4))]
    ev += [(2, 1, "bm25", 3.0, 1), (2, 2, "bm25", 3.0, 2)]
    schema = "query_id bigint, chunk_id bigint, retriever string, score double, rank int"
    e = spark.createDataFrame(ev + ev[:3], schema).withColumn("logged_at", F.lit(None).cast("timestamp")).withColumn("alpha", F.lit(9.0))
    q = spark.createDataFrame([(1, None), (2, float("nan"))], "query_id bigint, alpha double")
    got = fusion.fuse(e, q).collect()
    first = {r.query_id: (r.chunk_id, r.retrievers) for r in got if r["rank"] == 1}
    assert first == {1: (2, 2), 2: (1, 1)} and len(got) == 9
    scaled = e.withColumn("score", F.when(F.col("retriever") == "bm25", F.col("score") * 1000 + 5).otherwise(F.col("score")))
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in sorted(fusion.fuse(scaled, q).collect())] == [(r.query_id, r.chunk_id, r["rank"]) for r in sorted(got)]
    assert fusion.fuse(e.limit(0), q).count() == 0


def test_outliers_keep_their_order(spark):
    scores = [0.1 * i for i in range(1, 10)] + [1000.0, 5000.0, 4000.0]
    e = spark.createDataFrame([(1, c, "bm25", s, None, None) for c, s in enumerate(scores)], "query_id bigint, chunk_id bigint, retriever string, score double, rank int, logged_at timestamp")
    got = [r.chunk_id for r in fusion.fuse(e, spark.createDataFrame([], "query_id bigint, alpha double")).orderBy("rank").collect()]
    assert got == sorted(range(len(scores)), key=lambda c: -scores[c])


def test_hot_queries_come_to_the_same_result(spark):
    rng = random.Random(4)
    listed = [(q, c, r, None if rng.random() < 0.7 and 3 < c else rng.choice((1, 900)) * rng.random(), None if rng.random() < 0.1 else c // 2, None) for q in (1, 2) for r in ("bm25", "semantic", "symbol") for c in rng.sample(range(4000), 2000)]
    listed += [(3, 1, "symbol", None, 3, None), (3, 2, "symbol", None, None, None), (None, 2, "symbol", 1.0, 1, None)]
    table = spark.createDataFrame(listed, "query_id bigint, chunk_id bigint, retriever string, score double, rank int, logged_at timestamp")
    q = spark.createDataFrame([(1, 0.3)], "query_id bigint, alpha double")
    assert fusion.hot_queries(table.where("query_id is not null"), 0) and not fusion.hot_queries(table)
    assert rows(fusion.fuse(table, q, hot_rows=0)) == rows(fusion.fuse(table, q))
    # Scores are taken from the following rank, else from the preceding one.
    flat = table.withColumn("score", F.when(F.col("chunk_id") == 11, 7.0).when(F.col("chunk_id") == 500, 3.0)).withColumn("rank", F.col("chunk_id").cast("int"))
    z = {}
    for form in (fusion.standardised, fusion.standardised_in_stretches):
        got = {r.chunk_id: round(r.z, 9) for r in form(fusion.latest_evidence(flat.where("query_id = 1 and retriever = 'bm25'").unionByName(spark.createDataFrame([(1, c, "bm25", float(c % 11 - 4), c, None) for c in (11, 500)], flat.schema)))).collect()}
        z.setdefault("first", got)
        assert got == z["first"] and len({v for c, v in got.items() if c < 11}) <= 1 and len({v for c, v in got.items() if 11 < c}) <= 1
    assert fusion.fuse(table.where("query_id = 3"), q).count() == 1


def test_places_of_a_group_that_fills_the_table(spark):
    from quern.llm.ordering import numbered

    data = [(1 if i % 3 else i, i * 7919 % 3001) for i in range(3000)] + [(None, 5), (None, 4)]
    got = numbered(spark.createDataFrame(data, "g bigint, x bigint").repartition(7), "g", [F.desc("x")], "n").collect()
    groups = {}
    for g, x in data:
        groups.setdefault(g, []).append(x)
    assert {(r.g, r.x): r.n for r in got} == {(g, x): n for g, xs in groups.items() for n, x in enumerate(sorted(xs, reverse=True), 1)}


# ---- 5 -------------------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    x = np.concatenate([base + 0.15 * rng.standard_normal((60, 64)) for _ in range(6)] + [rng.standard_normal((300, 64))]).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (9001, None), (9002, [0.0] * 64), (9003, [1.0] * 32), (9004, [float("nan")] * 64), (None, x[0].tolist())]
    table = spark.createDataFrame(data, "chunk_id bigint, embedding array<float>").withColumn("neighbor", F.lit(0))
    got = {tuple(r) for r in neighbors.mutual_pairs(neighbors.nearest(table)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    true = {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
    assert true and len(got & true) >= 0.95 * len(true) and not got - true
    assert neighbors.nearest(table.limit(0)).count() == 0


def test_many_copies_do_not_explode(spark):
    v = np.random.default_rng(1).standard_normal(64).tolist()
    table = spark.createDataFrame([(i, v) for i in range(400)], "chunk_id bigint, embedding array<float>")
    counts = Counter(r.chunk_id for r in neighbors.nearest(table).collect())
    assert len(counts) == 400 and set(counts.values()) == {5}


def test_neighbours_in_large_and_crowded_sets(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(15)
    base, noise = rng.standard_normal((3000, 64)), rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(1, keepdims=True) * base
    planted = 0.86 * base + math.sqrt(1 - 0.86**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    copies = rng.standard_normal(64) + 0.2 * rng.standard_normal((5000, 64))
    x = np.concatenate([base, planted, copies, rng.standard_normal((4000, 64))]).astype(np.float32)
    pq.write_table(pa.table({"chunk_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = {}
    for r in neighbors.nearest(spark.read.parquet(str(tmp_path / "v.parquet"))).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbor)
    assert sum(i + 3000 in got.get(i, ()) for i in range(3000)) >= 0.98 * 3000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = np.arange(6000, 11_000, 10)
    s = u[some] @ u.T
    s[np.arange(len(some)), some] = -1
    best = np.argsort(-s, axis=1)[:, :5]
    assert sum(len(got[i] & set(b.tolist())) for i, b in zip(some, best)) >= 0.98 * best.size


def test_forest_follows_the_size():
    shapes = [neighbors.forest_shape(n, 0.85) for n in (0, 1000, 20_000, 200_000, 10**8)]
    assert shapes[0] == shapes[1] == (0, 1) and shapes == sorted(shapes) and shapes[-1][1] > 16
    shared = 1 - math.acos(0.85) / math.pi
    assert all(1 - (1 - shared**bits) ** trees >= neighbors.RECALL for bits, trees in shapes)


def test_full_nodes_are_divided():
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.standard_normal(64) + 0.01 * rng.standard_normal((500, 64)), rng.standard_normal((500, 64))]).astype(np.float32)
    projections = neighbors.planes(64, 4)
    full = neighbors.full_nodes(x, 1_000_000, projections, 9, 4)
    assert all(len(prefix) >= 1 and more.max() >= 7 for prefix, more in full)
    assert neighbors._common(np.array([0, 1 << 63, 5], dtype=np.uint64), np.array([0, 0, 4], dtype=np.uint64)).tolist() == [64, 0, 63]
    low, high = neighbors.settled_from(9, 16, 0.99), neighbors.settled_from(17, 16, 0.99)
    assert 0.8 < low < high < 1 and abs(1 - (1 - (1 - math.acos(high) / math.pi) ** 17) ** 16 - 0.99) < 1e-9


# ---- 6 -------------------------------------------------------------------------------------------------------------


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(40):
        text = [rng.choice(words) for _ in range(80)]
        texts[len(texts)] = " ".join(text)
        for _ in range(rng.randint(0, 3)):
            copy = list(text)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(80)] = rng.choice(words).upper()
            texts[len(texts)] = " ".join(copy)
    texts |= {1000: None, 1001: "", 1002: " \n", 1003: "two words", 1004: "two words", 1005: "two wordz", 1006: "-- ??", 1007: "x " * 50_000}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in texts.items() for w in [re.findall(r"[A-Za-z0-9_]+", (t or "").lower())]}
    true = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])} | {(1003, 1004)}
    table = spark.createDataFrame([chunk(i, content=t) for i, t in texts.items()] * 2, CHUNK).withColumn("head", F.lit(0))
    members, links = near_dup.near_duplicates(table)
    got = [tuple(r) for r in near_dup.all_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == true
    group = {r.chunk_id: r.group_id for r in near_dup.groups(members, links).collect()}
    assert all(group[a] == group[b] for a, b in true) and set(group) == set(texts) - {1000, 1001, 1002}
    assert near_dup.all_pairs(*near_dup.near_duplicates(table.limit(0))).count() == 0


def test_tries_hold_all_pairs_of_a_node():
    rng = random.Random(61)
    strings = sorted((rng.randrange(40), *(rng.randrange(3) for _ in range(near_dup.LEVELS))) for _ in range(400))
    node = np.array([s[0] for s in strings])
    tail = np.array([sum(h << near_dup.LEVEL_BITS * k for k, h in enumerate(reversed(s[1:]))) for s in strings])
    got = {(x, y): n for i, j, length in near_dup.trie_pairs(node, tail, 3) for x, y, n in zip(i.tolist(), j.tolist(), length.tolist())}
    common = lambda s, t: next((k for k in range(1, len(s)) if s[k] != t[k]), len(s)) - 1
    assert got == {(x, y): 3 + common(strings[x], strings[y]) for x in range(400) for y in range(x + 1, 400) if node[x] == node[y]}


def test_prefixes_are_shortened_to_the_target(spark):
    assert near_dup.prefix_length(0.6, 24, 0.99) == 3 and near_dup.prefix_length(0.9, 24, 0.99) > 8 and near_dup.prefix_length(0.01) == 1
    links = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.99), (1, 2, 0.6)], "head_a bigint, head_b bigint, similarity double")
    shares = [near_dup.found_share(links, length, 24) for length in (3, 4, 5, 6)]
    assert shares == sorted(shares, reverse=True) and shares[0] > 0.998 and near_dup.found_share(links.limit(0), 3, 24) == 0


def test_groups_follow_long_chains(spark):
    rng = random.Random(8)
    ids = rng.sample(range(10_000), 600)
    chains = [ids[:500], ids[500:]]
    links = spark.createDataFrame([(min(a, b), max(a, b), 0.7) for c in chains for a, b in zip(c, c[1:])], "head_a bigint, head_b bigint, similarity double")
    members = spark.createDataFrame([(i, i) for i in ids], "chunk_id bigint, head bigint")
    got = {r.chunk_id: (r.group_id, r.links) for r in near_dup.groups(members, links).collect()}
    assert got == {i: (min(c), 1 if i in (c[0], c[-1]) else 2) for c in chains for i in c}
    with pytest.raises(RuntimeError):
        near_dup.groups(members, links, rounds=1)


# ---- 7 -------------------------------------------------------------------------------------------------------------


def test_deltas_equal_a_recount(spark, tmp_path):
    schema = "term string, chunk_id bigint, tf int"
    old = [("a", 1, 2), ("A ", 1, 2), ("b", 1, None), ("a", 2, 1), (None, 2, 1), ("", 2, 4), ("c", None, 3)]
    new = [("a", 3, 7), ("d", 3, 1)]
    changed = [("a", 1, 1), ("e", 1, 4)]
    frame = lambda x: spark.createDataFrame(x, schema).withColumn("records", F.lit(0))
    state = term_counts.update_counts(None, added=frame(old))
    assert rows(state) == [("a", 3, 2), ("b", 1, 1)]
    store = term_counts.CountStore(spark, str(tmp_path / "counts"), buckets=4)
    assert store.read().count() == 0 and rows(store.apply(added=frame(old)).read()) == rows(state)
    # A later session opens the stored version; the join of its buckets with the delta shuffles the delta alone.
    again = term_counts.CountStore.open(spark, store.folder, store.version, 4)
    after = again.apply(added=frame(new), changed=(frame(old[:3]), frame(changed)), deleted=frame(old[3:5])).read()
    assert rows(after) == rows(term_counts.update_counts(None, added=frame(new + changed))) == [("a", 8, 2), ("d", 1, 1), ("e", 4, 1)]
    marks = {r.term: r.mark for r in term_counts.mark_terms(after, 4, rare_below=2).collect()}
    assert marks == {"a": "common", "d": "rare", "e": "rare"}
    assert term_counts.update_counts(None, added=frame(old).limit(0)).count() == 0
    assert again.apply(added=frame(old).limit(0)).read().count() == 3


def test_packed_totals_equal_a_recount(spark):
    from quern.llm import packed

    rng = random.Random(7)
    posts = [(f"t{int(rng.expovariate(0.05))}é", rng.choice((-5, 1, 2**40)) * rng.randrange(300), rng.randrange(1, 400)) for _ in range(20_000)]
    posts += [("hot", i, 1) for i in range(9000)] + [(f"of one {i}", 7, 70_000) for i in range(9000)]
    best = {}
    for t, c, n in posts:
        best[t, c] = max(n, best.get((t, c), 0))
    want = Counter()
    for (t, _), n in best.items():
        want[t] += n
    got = packed.term_totals(spark.createDataFrame(posts, "term string, chunk_id bigint, tf int"), rows=5_000_000).collect()
    assert {r.term: r.occurrences for r in got} == want and {r.term: r.records for r in got} == Counter(t for t, _ in best)
    codes, ids, tf = np.array([0, 1, 0]), np.array([-3, -3, 2**50]), np.array([1, 9, 300])
    terms, *rest = packed.decode_block(packed.encode_block([b"x", "ü".encode()], codes, ids, tf))
    assert terms.to_pylist() == ["x", "ü"] and all((a == b).all() for a, b in zip(rest, (codes, ids, tf)))


# ---- 8 -------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "Hello  world's\n\n\tit'll <|endoftext|> do", "naïve Ünïcödé 漢字かな 🙂🏽", "a" * 9000, "=" * 3001 + "x", "a\u00a0\t\tb\x1cc \u2003 d", "x1y22 333 \r\n z", "\x00\x07", "don't'sabc ''s", "word " * 3000, "antidisestablishmentarianism" * 4]
    table = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    library = Tokenizer.from_file(bpe.TOKENIZER)
    library.encode_special_tokens = True
    got = bpe.encode_documents(table)
    for r in got.collect():
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, r.doc_id
    assert got.count() == len(texts) + 1
    assert {r.doc_id: r.text for r in bpe.decode_ids(got).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(table).collect()} == {r.doc_id: len(r.ids) for r in got.collect()}
    assert bpe.encode_documents(table.limit(0)).count() == 0


def test_long_words_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(81)
    library = Tokenizer.from_file(bpe.TOKENIZER)
    library.encode_special_tokens = True
    encoder = bpe.WordEncoder(*bpe.load_merges(bpe.TOKENIZER))
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aents", "ab", "=-", "éüñß", "漢字かな", "\u0e01\u0e33"]
    words = ["".join(rng.choice(a) for _ in range(rng.choice((49, 64, 300, 5000)))) for a in alphabets for _ in range(12)]
    words += ["a" * n for n in (49, 65, 97, 12_345)] + ["=" * n + x for n in (64, 127, 4096) for x in ("", "-")] + ["".join(rng.choice(alphabets[0]) for _ in range(1_000_000))]
    offsets, ids = encoder.encode(words)
    for i, w in enumerate(words):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(w, add_special_tokens=False).ids, w[:60]


# ---- 9 -------------------------------------------------------------------------------------------------------------


def test_packing_keeps_everything(spark):
    rng = random.Random(9)
    sizes = [(i, int(rng.expovariate(1 / 40)) + 1) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 1000), (5003, 333), (5004, 100)]
    table = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").withColumn("step", F.lit(1))
    capacities = spark.createDataFrame([(1, 100, "x"), (2, 64, "x"), (3, None, "x"), (4, 0, "x"), (2, 64, "x")], "capacity_id bigint, tokens int, tokenizer string")
    packed = packing.pack_sizes(table, capacities).collect()
    for c, capacity in ((1, 100), (2, 64)):
        mine = [r for r in packed if r.capacity_id == c]
        load = Counter()
        for r in mine:
            load[r.container_id] += r.tokens
        assert max(load.values()) <= capacity and sum(load.values()) == sum(t or 0 for _, t in sizes)
        assert len(load) * capacity <= 1.02 * sum(load.values()) + capacity
        for doc, tokens in sizes:
            parts = sorted((r.piece, r.start, r.tokens) for r in mine if r.doc_id == doc) if doc >= 5000 else None
            if parts is not None:
                assert sum(p[2] for p in parts) == (tokens or 0) and [p[0] for p in parts] == list(range(len(parts))) and len(parts) == max(1, -(-(tokens or 0) // capacity))
        assert Counter(r.doc_id for r in mine if r.doc_id < 5000).keys() == {d for d, _ in sizes if d < 5000}
        steps = {}
        for r in mine:
            steps.setdefault(r.step, set()).add(r.container_id)
        weights = [sum(load[x] for x in xs) for xs in steps.values()]
        assert max(map(len, steps.values())) <= packing.STEP and max(weights) - min(weights) <= capacity
    assert {r.capacity_id for r in packed} == {1, 2}
    assert packing.pack_sizes(table.limit(0), capacities).count() == 0 and packing.pack_sizes(table, capacities.limit(0)).count() == 0


def test_tiers_are_packed_before_they_are_filled():
    # 5 + 3 + 2 would close a container at once; the tier of 5 is packed first, and 9 is filled from shorter tiers only.
    counts = np.bincount([9, 5, 5, 3, 2, 1], minlength=11)
    entries, runs = packing.plan(counts, 10)
    inside = {}
    for size, _, n, first in entries:
        for x in range(first, first + n):
            inside.setdefault(x, []).append(size)
    assert sorted(map(sorted, inside.values())) == [[1, 9], [2, 3], [5, 5]] and [r[2] for r in runs] == [10, 10, 5]
    assert [packing.tier_of(s, 10) for s in (10, 6, 5, 3, 2, 1)] == [0, 0, 1, 1, 2, 3]
    assert packing.plan(np.bincount([7], weights=[3e8], minlength=9).astype(np.int64), 8)[1] == [(0, 300_000_000, 7)]


# ---- 10 ------------------------------------------------------------------------------------------------------------


def test_repeated_words_against_brute_force():
    def brute(words):
        seen, hit = {}, [False] * len(words)
        for i in range(len(words) - 3):
            g = tuple(words[i : i + 4])
            if g in seen:
                hit[i : i + 4] = [True] * 4
            seen.setdefault(g, i)
        return sum(hit)

    rng = random.Random(10)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert repetition.repeated_words(words) == brute(words)
    assert repetition.repeated_words(["a"] * 6) == 5


def test_repetition_and_sources(spark):
    plain = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnop")
    loop = "buy this thing right now or never " * 20
    docs = [(i, loop if i < 8 else plain, "spam" if i < 8 else "good") for i in range(40)] + [(100, None, "good"), (101, "", None), (102, "a b c d " * 4, None), (103, "Ünï Çö " * 30, None), (104, loop * 500, None), (105, "\u0130stanbul " * 30, None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("share", F.lit(2.0))
    got = {r.doc_id: r for r in repetition.assess(table).collect()}
    assert len(got) == len(docs)
    assert {i for i, r in got.items() if r.repetitive} == {*range(8), 103, 104, 105} and got[105].words == 30
    assert got[0].source_suspect and not got[20].source_suspect and got[101].source_rate is None and got[100].share == 0
    assert got[0].fails and not got[20].fails and got[0].source_rate > got[20].source_rate
    assert repetition.assess(table.limit(0)).count() == 0

"""Tokens of many texts in arrays, against the tokens of one text."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import postings
from quern.operators.encoders import tokenize
from quern.operators.ranked import packed, unpacked
from quern.operators.sparse import UNIT, best_sums
from quern.operators.vocabulary import cut_by_case

WORDS = ["getHTTPResponse", "parse_config2Value", "classes", "A1b2C3", "___", "_x__yS", "serialisedAuth", "X", "HTTPServer2x", "the", "stories"]


@pytest.fixture
def batch():
    texts = [" ".join(WORDS[i % 11 :: 1 + i % 3]) + f" w{i}Tail\n x=1" for i in range(30)] + ["", None, "é ñ 12"]
    symbols = [[{"name": WORDS[i % 11], "kind": "def"}, {"name": None, "kind": "class"}] if i % 3 == 0 else None if i % 3 == 1 else [] for i in range(33)]
    kind = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())]))
    paths = [f"a/./b/getUser{i % 4}/c/file_x.test.c" if i % 2 else "README" for i in range(33)]
    crumbs = [[WORDS[i % 7], None] if i % 2 else [] for i in range(33)]
    columns = [pa.array(range(33)), pa.array(paths), pa.array(texts), pa.array(symbols, kind), pa.array(crumbs, pa.list_(pa.string())), pa.array(["go" if i % 2 else None for i in range(33)])]
    return pa.RecordBatch.from_arrays(columns, names=[*postings.INDEXED, "language"])


@pytest.mark.parametrize("at_once", [7, 2000])
def test_bags(batch, at_once, monkeypatch):
    monkeypatch.setattr(postings, "AT_ONCE", at_once)
    monkeypatch.setattr(postings, "REMEMBERED", 20 if at_once == 7 else 1_000_000)
    asked = {t: i + 1 for i, t in enumerate(tokenize("getHTTPResponse classes a1b2 config authentication def file go stories"))}
    of = lambda texts: {t for x in texts for t in tokenize(x or "")}
    rows = [r for b in postings._bags(asked, 16, {"getHTTPResponse": 1})([batch]) for r in b.to_pylist()]
    assert len(rows) == 33
    for r, c in zip(rows, batch.to_pylist()):
        symbols, crumbs = c["symbols"] or [], c["breadcrumbs"]
        counts = Counter(t for x in [c["content"], *postings._pieces(c["file_path"], symbols, crumbs)] for t in of([x]))
        assert r["id"] == c["chunk_id"] and r["n"] == counts.total()
        assert sorted(zip(r["codes"], r["tfs"])) == sorted((asked[t], n) for t, n in counts.items() if t in asked)
        names = [s["name"] for s in symbols]
        v = np.zeros(16)
        for t in of([c["content"], "path language symbols context", c["file_path"], c["language"] or "unknown", *names, *crumbs]):
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += 1 if h[8] < "8" else -1
        assert (postings.unpacked_vectors(pa.array([r["v"]]), 16)[0] == v).all()
        path = of([c["file_path"]])
        card = path | of([c["language"], *names, *(s["kind"] for s in symbols), *crumbs])
        assert sorted(r["card"]) == sorted(2 * asked[t] + (t in path) for t in card if t in asked)


def test_definitions_of_a_batch(batch):
    texts = pa.array(["class getHTTPResponse:", "GETHTTPRESPONSE", "x"] * 11)
    named = pa.RecordBatch.from_arrays([*batch.columns[:2], texts, *batch.columns[3:]], names=batch.schema.names)
    defs = [d for b in postings._bags({}, 0, {"getHTTPResponse": 1})([named]) for d in b.column("defs").to_pylist()]
    assert defs == [[4], [], []] * 11


def test_cut_by_case():
    assert cut_by_case("\n".join(WORDS)).split("\n")[:5] == ["get HTTP Response", "parse_config 2 Value", "classes", "A1 b 2 C3", "___"]


def test_hits_take_no_room_for_zeros():
    ids, units = np.array([7, 3, 900]), np.array([5, -1, 2**40])
    assert (unpacked([packed(ids, units), b""], 2) == [[3, 7, 900], [-1, 5, 2**40]]).all()
    assert unpacked([b""], 2).shape == (2, 0) and len(packed(np.arange(1000), np.ones(1000, dtype=np.int64))) < 2100


def test_best_sums():
    total = np.random.default_rng(3).choice([0, 0.2e-6, 1, 1 + 0.2e-6, 1 + 0.4e-6, 1.5, 2], 500)
    units = np.floor(total * UNIT + 0.5)
    for k in (1, 90, 200, 300, 499, 600):
        want = sorted(np.flatnonzero(units), key=lambda i: (-units[i], i))[:k]
        at, got = best_sums(total, k)
        assert set(at.tolist()) == set(want) and (got == units[at]).all()

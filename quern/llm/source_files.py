"""Problem 1: files that nobody wrote by hand, by belief propagation over the directory trees.

Every file and every directory has a hidden label.  A file's content and name, and a directory's name, are evidence for
its label; a parent and a child, and through the parent all siblings, are tied by the tables ``DIRECTORY_TIES`` and ``FILE_TIES``.  Messages go up the
levels of the trees and down again, which is exact on a tree.  The messages of a directory's children are sums, so a
directory that holds a third of all files is aggregated before it is shuffled.

What a sign is worth is fitted to the collection: the labels that propagation infers say how often files of each label
show the sign, and these shares are the weights of the next round.  The first round's weights count as ``PRIOR_FILES``
files, so that they hold where there is little to learn from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

#: Chance of a directory's label (columns, as in LABELS) under its parent's (rows).
DIRECTORY_TIES = (
    (0.991989, 0.005, 0.002, 0.000001, 0.00101),
    (0.300, 0.640, 0.020, 0.020, 0.020),
    (0.500, 0.020, 0.440, 0.020, 0.020),
    (0.010, 0.010, 0.010, 0.960, 0.010),
    (0.500, 0.020, 0.020, 0.020, 0.440),
)
#: Chance of a file's label (columns) under its directory's (rows).
FILE_TIES = (
    (0.82, 0.05, 0.03, 0.07, 0.03),
    (0.30, 0.60, 0.03, 0.04, 0.03),
    (0.35, 0.05, 0.50, 0.05, 0.05),
    (0.02, 0.04, 0.04, 0.88, 0.02),
    (0.40, 0.05, 0.05, 0.05, 0.45),
)
#: A repository as a whole is somebody's own work.
ROOT_PRIOR = (0.0, -50.0, -50.0, -50.0, -50.0)
#: Rounds in which the weights of the signs are fitted, how many files the first weights count for, and their bound.
ROUNDS = 1
PRIOR_FILES = 5.0
MOST = 12.0
#: First log-odds of a file's label given content and name without any sign.  Vendored code reads like other code, but for signs.
FILE_PRIOR = (0.0, -4.0, -4.0, -0.7, -4.0)
#: The weight of a directory's name that settles its label.
SETTLED = 200.0

# Names and phrases that tools and package managers leave behind.
VENDOR_DIRS = ("third_party", "third-party", "thirdparty", "3rdparty", "_vendor", "vendored", "node_modules", "bower_components", "site-packages", "Pods", "jspm_packages")
#: Ambiguous names: they hold other people's code at the top of a project, but may be a subject of its own below its sources.
VENDOR_DIRS_AT_TOP = ("vendor", "external", "extern", "externals", "deps", "upstream")
SOURCE_DIRS = ("src", "lib", "libs", "main", "app", "apps", "core", "pkg", "cmd", "internal", "services", "service", "tests", "test", "java", "python", "modules", "domain")
GENERATED_DIRS = ("generated", "gen", "__generated__", "autogen", "codegen-out", "generated-src")
GENERATED_NAMES = r"(?:\.gen|\.generated|_generated|\.g|\.pb|\.designer)\.\w+$|_pb2(?:_grpc)?\.pyi?$|_pb\.[jt]s$|(?:OuterClass|Grpc)\.java$|^zz_generated|_bindings\.rs$"
MINIFIED_NAMES = r"[.-](?:min|prod|bundle)\.(?:js|css|mjs)$|\.chunk(?:\.[0-9a-f]+)?\.js$|\.[0-9a-f]{8,}\.(?:js|css)$"
GENERATED_SIGNS = re.compile(
    r"code generated by .{1,80}do not edit|@generated\b|<auto-?generated\b|\bautogenerated (?:file|code|by|from)|auto-?generated file|"
    r"\b(?:generated|produced) (?:from|by) \S+.{0,40}(?:do not|don't|at build time)|this file (?:was|is) (?:automatically|auto-?)\s?(?:generated|produced)|"
    r"\bmachine[- ](?:written|generated) by\b|\b(?:changes|edits)\b.{0,24}\b(?:overwritten|lost on the next)|wrote this file; changes are lost|"
    r"^\W*output of \w+ --\w+|^\W*do not edit\W*$|nicht von hand bearbeiten|ne pas modifier|no (?:editar|modificar) (?:a mano|manualmente)|non modificare",
    re.IGNORECASE,
)
VENDORED_SIGNS = re.compile(
    r"^\W*copyright (?:\(c\) )?.{0,40}\bthe [\w.-]+ (?:contributors|authors|developers)\b|^\W*[\w.-]+ - v?\d+(?:\.\d+)+ - released under|\bpart of [\w.-]+, distributed under|"
    r"\bimported from the [\w.-]+ project\b|\bcopied (?:unmodified|verbatim) from\b|\bbundled copy\b|\bincluded verbatim\b|\bsend fixes upstream\b|"
    r"^\W*\(c\) [\w.-]+ (?:developers|contributors|authors)|^\W*(?:this is a )?vendored (?:copy|from)\b",
    re.IGNORECASE,
)
BUNDLE_SIGNS = re.compile(r"^//[#@] sourceMappingURL=|^/\*! ?[\w.-]+ v?\d+(?:\.\d+)+", re.MULTILINE)

_COMMENT = re.compile(r"^[ \t]*(?://|#(?![\[!]|include|define|if|endif|pragma)|--|/?\*|<!--|\"\"\"|;|%)")
_COMMENT_LINES = re.compile(rb"^[ \t]*(?://|#(?![\[!]|include|define|if|endif|pragma)|--|/?\*)[^\n]*\n", re.MULTILINE)
_SHAPES = bytes(ord("a") if chr(b).isalpha() and b < 128 or b == 95 or b > 127 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_BASE64 = re.compile(r"^\s*['\"]?[A-Za-z0-9+/=]{40,}['\"]?")

FEATURES = ("letters", "data", "packed", "blocks", "alike", "generated", "vendored", "bundled")


def evidence(content: str, at_top: bool) -> tuple[int, ...]:
    """``FEATURES`` of a piece of a file: letters in all, in lines of data and in packed lines; blocks, and those of the commonest shape; signs."""
    text = content.replace("\r\n", "\n")
    data = packed = 0
    lines = text.split("\n")
    for line in lines:
        n = len(line)
        if n < 8:
            continue
        digits = n - len(line.translate(_NO_DIGITS))
        if digits > 0.25 * n or (n >= 40 and _BASE64.match(line)):
            data += n
        elif n >= 80 and line.count(" ") < 0.08 * n:
            # Code that somebody wrote has more space between its words, whatever the length of its lines.
            packed += n
    shapes = re.sub(rb"0+", b"0", re.sub(rb"a[a0]*", b"a", _COMMENT_LINES.sub(b"", text.encode("utf-8", "replace")).translate(_SHAPES)))
    blocks = [b for b in re.split(rb"\n\s*\n", re.sub(rb"\n[ \t]+", b"\n", shapes.strip())) if b.strip()]
    alike = max(Counter(blocks).values()) if blocks else 0
    alike = alike if alike >= 3 else 0
    generated = vendored = 0
    for i, line in enumerate(lines):
        if _COMMENT.match(line):
            made, bought = bool(GENERATED_SIGNS.search(line)), bool(VENDORED_SIGNS.search(line))
            if (made or bought) and ((at_top and i < 20) or not _quoted(lines, i)):
                generated += made
                vendored += bought
    return len(text), data, packed, len(blocks), alike, generated, vendored, len(BUNDLE_SIGNS.findall(text))


_NO_DIGITS = {i: None for i in range(48, 58)}


def _quoted(lines: list[str], i: int) -> bool:
    """Whether line ``i`` lies within a string of several lines, as in a template: one opens before it and closes after it."""
    before, after = "\n".join(lines[:i]), "\n".join(lines[i + 1 :])
    return any(before.count(q) % 2 and after.count(q) % 2 for q in ('"""', "'''", "`"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, paths, starts, texts = (batch.column(i) for i in range(4))
        made = [evidence(t or "", s is None or s <= 3) for s, t in zip(starts.to_pylist(), texts.to_pylist())]
        yield pa.RecordBatch.from_arrays([paths, keys, *(pa.array([m[i] for m in made], pa.int64()) for i in range(len(FEATURES)))], names=["file_path", "chunk_id", *FEATURES])


def file_evidence(chunks: DataFrame) -> DataFrame:
    """``(file_path, FEATURES)``, one row per file.  Repeated rows of a chunk count once; a null content has no signs."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.where("file_path is not null").select("chunk_id", "file_path", "start_line", "content")
    made = rows.mapInArrow(_rows, f"file_path string, chunk_id {kind}, " + ", ".join(f"{f} bigint" for f in FEATURES))
    once = made.groupBy("file_path", "chunk_id").agg(F.max(F.struct(*FEATURES)).alias("_e")).select("file_path", "_e.*")
    return once.groupBy("file_path").agg(*(F.sum(f).alias(f) for f in FEATURES))


def file_signs() -> list[tuple[str, Column, int, float]]:
    """``(name, condition, label, weight)``: signs from a file's evidence and name, the label each speaks for, and its first log-odds."""
    name = F.element_at(F.split("file_path", "/"), -1)
    letters = F.greatest(F.col("letters"), F.lit(1))
    alike = (F.col("blocks") >= 5) & (F.col("alike") >= 0.6 * F.col("blocks"))
    return [
        ("s_generated", F.col("generated") > 0, 1, 10), ("s_alike", alike, 1, 9), ("s_generated_name", name.rlike(GENERATED_NAMES), 1, 3),
        ("s_packed", F.col("packed") / letters > 0.6, 2, 9), ("s_minified_name", name.rlike(MINIFIED_NAMES), 2, 3), ("s_bundled", F.col("bundled") > 0, 2, 4),
        ("s_vendored", F.col("vendored") > 0, 3, 9), ("s_data", F.col("data") / letters > 0.6, 4, 10),
    ]


SIGNS = ("s_generated", "s_alike", "s_generated_name", "s_packed", "s_minified_name", "s_bundled", "s_vendored", "s_data")


#: Per label the log-odds against handwritten without any sign, and what each sign adds when it is there.
Weights = list[tuple[float, list[float]]]


def first_weights() -> Weights:
    """A sign counts for the label it speaks for and for no other."""
    return [(FILE_PRIOR[label], [float(w) if label == of else 0.0 for _, _, of, w in file_signs()]) for label in range(len(LABELS))]


def file_odds(weights: Weights) -> list[Column]:
    """Log-odds of a file's labels against handwritten, from its signs; columns x0 to x4."""
    return [sum((F.when(F.col(s), F.lit(w)).otherwise(F.lit(0.0)) for s, w in zip(SIGNS, row)), F.lit(none)).alias(f"x{i}") for i, (none, row) in enumerate(weights)]


def fitted(judged: DataFrame) -> Weights:
    """The weights that follow from the inferred labels: from the share of each label's files that show a sign against the
    share of handwritten ones, with signs taken as independent."""
    chance = [F.exp(F.col(x) - _log_sum([F.col(c) for c in _X])) for x in _X]
    sums = judged.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"n{i}") for i, c in enumerate(chance)), *(F.coalesce(F.sum(F.when(F.col(s), c)), F.lit(0.0)).alias(f"n{i}_{s}") for i, c in enumerate(chance) for s in SIGNS)).collect()[0]

    def share(label: int, k: int) -> float:
        _, _, of, weight = file_signs()[k]
        first = 0.5 if label == of else 0.5 * math.exp(-weight)
        return (sums[f"n{label}_{SIGNS[k]}"] + PRIOR_FILES * first) / (sums[f"n{label}"] + PRIOR_FILES)

    def bound(x: float) -> float:
        return max(-MOST, min(MOST, x))

    shares = [[share(label, k) for k in range(len(SIGNS))] for label in range(len(LABELS))]
    plain, out = shares[0], []
    for label, row in enumerate(shares):
        none = bound(sum(math.log((1 - a) / (1 - b)) for a, b in zip(row, plain)))
        adds = [bound(math.log(a / (1 - a)) - math.log(b / (1 - b))) for a, b in zip(row, plain)]
        # In a small collection a label's few files would talk its own signs down: none falls below its first weight.
        first = [weight + FILE_PRIOR[label] - none if label == of else -MOST for _, _, of, weight in file_signs()]
        out.append((none, [max(a, f) for a, f in zip(adds, first)]))
    return out


def directory_odds() -> list[Column]:
    """The same for a directory, from the names on its path, and ``named``: such a name says what the directory is wherever
    it stands, so it is not tied to its parent; everything below a vendored directory is vendored too."""
    parts = F.split("node", "/")
    name = F.element_at(parts, -1)
    words = lambda names: "(?:" + "|".join(re.escape(n) for n in names) + ")"
    # At the top: below the repository and at most the project, not below sources.
    below = f"(?:^|/)(?!{words(SOURCE_DIRS)}/)[^/]+/{words(VENDOR_DIRS_AT_TOP)}(?:/|$)"
    sure = F.col("node").rlike(f"/{words(VENDOR_DIRS)}(?:/|$)") | F.col("node").rlike(r"/[A-Za-z][\w.-]*-v?\d+\.\d+(?:\.\d+)*(?:/|$)") | F.col("node").rlike(below)
    made = name.isin(*GENERATED_DIRS) & ~sure
    vendored = F.when(sure, F.lit(SETTLED)).otherwise(F.lit(0.0))
    generated = F.when(made, F.lit(2.0)).otherwise(F.lit(0.0))
    odds = (F.lit(0.0), generated, F.lit(0.0), vendored, F.lit(0.0))
    prior = [F.when(F.size(parts) == 1, F.lit(x)).otherwise(F.lit(0.0)) for x in ROOT_PRIOR]
    return [*((prior[i] + o).alias(f"x{i}") for i, o in enumerate(odds)), (sure | made).alias("named")]


_X, _M, _T = (tuple(f"{c}{i}" for i in range(len(LABELS))) for c in "xmt")


def _log_sum(terms: list[Column]) -> Column:
    top = F.greatest(*terms)
    return top + F.log(sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top)))


def _upward(ties: tuple) -> list[Column]:
    """The message of a node to its parent: for each label of the parent, the log of the sum over the node's labels."""
    return [_log_sum([F.col(_X[x]) + math.log(ties[p][x]) for x in range(len(LABELS))]).alias(_M[p]) for p in range(len(LABELS))]


def _downward(ties: tuple) -> list[Column]:
    """The beliefs of a node (x plus what comes from its parent); t is the parent's belief, m the node's own message in it."""
    coming = [_log_sum([F.col(_T[p]) - F.col(_M[p]) + math.log(ties[p][x]) for p in range(len(LABELS))]) for x in range(len(LABELS))]
    return [(F.col(_X[x]) + coming[x]).alias(_X[x]) for x in range(len(LABELS))]


def _parent(node: str) -> Column:
    return F.when(F.instr(node, "/") > 0, F.regexp_replace(node, r"/[^/]*$", ""))


def label_files(chunks: DataFrame, salts: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``(file_path, label, handwritten)``: the likeliest label of every file and the chance that it is handwritten.

    A file without content, or whose path has no directory, is judged by what there is.  Equal chances go to the label
    that comes first in ``LABELS``.  Rows without a path are left out.
    """
    signs = [F.coalesce(condition, F.lit(False)).alias(name) for name, condition, _, _ in file_signs()]
    files = cut(file_evidence(chunks).select("file_path", _parent("file_path").alias("parent"), *signs))
    directories = cut(_directories(files))
    deepest = directories.agg(F.max("level")).collect()[0][0] or 0
    weights = first_weights()
    for _ in range(rounds):
        weights = fitted(propagated(files, directories, deepest, weights, salts))
    # The beliefs are settled before labels are read from them, so that the generated code stays small.
    judged = propagated(files, directories, deepest, weights, salts).select(F.inline(F.array(F.struct("file_path", *_X))))
    best = F.greatest(*_X)
    label = F.coalesce(*(F.when(F.col(x) == best, F.lit(name)) for x, name in zip(_X, LABELS)))
    return judged.select("file_path", label.alias("label"), F.exp(F.col("x0") - _log_sum([F.col(x) for x in _X])).alias("handwritten"))


def _directories(files: DataFrame) -> DataFrame:
    """``(node, level, parent, x0 .. x4, named)``: all directories above a file, each with its level and what its name says."""
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("parent", "/"))), lambda i: F.struct(F.array_join(F.slice(F.split("parent", "/"), 1, i), "/").alias("node"), i.alias("level")))
    nodes = files.where("parent is not null").select("parent").distinct().select(F.inline(steps)).distinct()
    return nodes.select("node", "level", _parent("node").alias("parent"), *directory_odds())


def propagated(files: DataFrame, directories: DataFrame, deepest: int, weights: Weights, salts: int) -> DataFrame:
    """The files' beliefs, ``(file_path, signs, x0 .. x4)``, after messages went up the trees and down again."""
    leaves = files.select("file_path", "parent", *SIGNS, *file_odds(weights)).select("*", *_upward(FILE_TIES))
    sums = leaves.where("parent is not null").groupBy("parent").agg(*(F.sum(m).alias(m) for m in _M))
    own = sums.select(F.col("parent").alias("node"), *_M)
    added = [(F.col(x) + F.coalesce(m, F.lit(0.0))).alias(x) for x, m in zip(_X, _M)]
    base = cut(directories.join(own, "node", "left").select("node", "level", "parent", "named", *added))
    loose = [F.when(F.col("named"), F.lit(0.0)).otherwise(m).alias(name) for m, name in zip(_upward(DIRECTORY_TIES), _M)]
    up: dict[int, DataFrame] = {}
    for level in range(deepest, 0, -1):
        here = base.where(F.col("level") == level)
        if level < deepest:
            below = up[level + 1].groupBy("parent").agg(*(F.sum(m).alias(m) for m in _M)).withColumnRenamed("parent", "node")
            here = here.join(below, "node", "left").select("node", "parent", "named", *added)
        up[level] = cut(here.select("node", "parent", "named", *_X, *loose))
    beliefs: list[DataFrame] = []
    for level in range(1, deepest + 1):
        here = up[level]
        if level == 1:
            beliefs.append(here.select("node", *_X))
            continue
        above = beliefs[-1].select(F.col("node").alias("parent"), *(F.col(x).alias(t) for x, t in zip(_X, _T)))
        tied = [F.when(F.col("named"), F.col(x)).otherwise(b).alias(x) for x, b in zip(_X, _downward(DIRECTORY_TIES))]
        beliefs.append(cut(here.join(above, "parent").select("node", *tied)))
    columns = ["file_path", *SIGNS, *_X]
    if not beliefs:
        return leaves.select(*columns)
    total = beliefs[0]
    for b in beliefs[1:]:
        total = total.unionByName(b)
    # One directory may hold a third of all files: its row is repeated for each salt, its files are spread over them.
    above = total.select(F.col("node").alias("parent"), *(F.col(x).alias(t) for x, t in zip(_X, _T)), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = leaves.withColumn("_salt", F.pmod(F.xxhash64("file_path"), F.lit(salts)).cast("int"))
    within = salted.where("parent is not null").join(above, ["parent", "_salt"]).select("file_path", *SIGNS, *_downward(FILE_TIES))
    return within.unionByName(leaves.where("parent is null").select(*columns))

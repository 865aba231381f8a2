"""Source trees as rows: the listing on the driver, reading and chunking on the workers."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# File types, and names that are never indexed.
CODE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "bash", ".bash": "bash", ".sql": "sql", ".lua": "lua",
    ".ex": "elixir", ".exs": "elixir", ".hs": "haskell", ".zig": "zig",
}
DOCUMENTS = {".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json"}
IGNORED_DIRS = {".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache", "dist", "build", ".eggs"}
IGNORED_FILES = {"package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "Cargo.lock", "composer.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "coverage.json"}
MAX_FILE_BYTES = 1_000_000
WINDOW, OVERLAP = 50, 5


def extensions(values: Iterable[str] | None, include_documents: bool = False) -> dict[str, str]:
    """The file types to index: the named extensions, else code, with documents where asked for.  A blank list is no list."""
    named = sorted({"." + v.strip().lstrip(".").lower() for v in values or () if v.strip().strip(".")})
    known = CODE | DOCUMENTS
    if named:
        return {e: known.get(e, "") for e in named}
    return known if include_documents else CODE


def language_for_path(path: str) -> str | None:
    return (CODE | DOCUMENTS).get(os.path.splitext(path)[1].lower())


class IgnoreRules:
    """The rules of one ignore file: comments, negation, anchors, directories only, ``*``, ``?``, ``[...]`` and ``**``."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep or line.startswith("\\") else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((keep, only_dirs, re.compile(("" if anchored else "(?:.*/)?") + self._pattern(line.lstrip("/")) + r"\Z")))

    @staticmethod
    def _pattern(glob: str) -> str:
        out = ""
        for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\])", glob):
            out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (fnmatch.translate(part)[4:-3] if part.startswith("[") else re.escape(part))
        return out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept by a negation; None: no rule speaks.  The last rule that fits holds."""
        found = None
        for keep, only_dirs, pattern in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                found = not keep
        return found


def rules_above(root: str) -> list[tuple[str, IgnoreRules]]:
    """``(folder, rules)`` that hold for the root from outside it, the weakest first: the user's global file, the
    repository's exclude file, the ignore files of the folders above up to the repository's top."""
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    files, above = [(root, os.path.join(config, "git", "ignore"))], []
    folder = root
    while True:
        if os.path.isdir(os.path.join(folder, ".git")):
            files.append((folder, os.path.join(folder, ".git", "info", "exclude")))
            break
        if os.path.dirname(folder) == folder:
            above = above[:0]
            break
        folder = os.path.dirname(folder)
        above[:0] = [(folder, os.path.join(folder, name)) for name in (".gitignore", ".ignore")]
    out = []
    for base, path in [*files, *above]:
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out.append((base, IgnoreRules(f.read())))
    return out


def walk(root: str, types: dict[str, str], ignore: Iterable[str] = ()) -> list[str]:
    """Relative paths of the files to index, in the order of their path components.

    Nested ``.gitignore`` and ``.ignore`` files hold for what is below them, the nearest first, then those of the folders
    above the root, the repository's own exclude file and the user's global ignore file; hidden names, default
    directories and lock files, the caller's names, other types and files above the size limit are left out.
    """
    skip, found = set(ignore), []
    root = os.path.abspath(root)

    def visit(directory: str, above: list[tuple[str, IgnoreRules]]) -> None:
        rules = list(above)
        for name in (".gitignore", ".ignore"):
            path = os.path.join(root, directory, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    rules.append((os.path.join(root, directory), IgnoreRules(f.read())))
        for entry in sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name):
            name, path = entry.name, f"{directory}/{entry.name}" if directory else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            if name.startswith(".") or name in skip or name in (IGNORED_DIRS if is_dir else IGNORED_FILES):
                continue
            verdicts = (r.verdict(os.path.relpath(os.path.join(root, path), base).replace(os.sep, "/"), is_dir) for base, r in reversed(rules))
            if next((v for v in verdicts if v is not None), False):
                continue
            if is_dir:
                visit(path, rules)
            elif entry.is_file(follow_symlinks=False) and os.path.splitext(name)[1].lower() in types and entry.stat().st_size <= MAX_FILE_BYTES:
                found.append(path)

    visit("", rules_above(root))
    return sorted(found, key=lambda p: p.split("/"))


def signatures(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    stats = [(p, os.stat(os.path.join(root, p))) for p in paths]
    return spark.createDataFrame([(p, s.st_size, s.st_mtime_ns) for p, s in stats], "path string, len bigint, modified_ns bigint")


def read_tree(spark: SparkSession, root: str, include_documents: bool = False, only: Iterable[str] | None = None, ignore: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(files, warnings)``: ``(file_path, language, content)`` of readable files, ``(path, message)`` of the others.

    The root must be a folder that all workers see.  A file that is not UTF-8 becomes a warning and never stops the rest.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    paths = walk(root, extensions(only, include_documents), ignore)
    if not paths:
        raise ValueError("No supported files found.")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
                        rows.append((path, language_for_path(path), f.read(), None))
                except (UnicodeDecodeError, OSError) as e:
                    why = "stream did not contain valid UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)
                    rows.append((path, None, None, f"skipped indexed file: {why}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["file_path", "language", "content", "message"])

    listed = spark.createDataFrame([(p,) for p in paths], "file_path string").repartition(max(1, min(len(paths) // 64 + 1, 1024)))
    made = listed.mapInArrow(read, "file_path string, language string, content string, message string")
    return made.where("message is null").drop("message"), made.where("message is not null").selectExpr("file_path as path", "message")


def line_windows(files: DataFrame, lines: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``(file_path, language, ordinal, start_line, end_line, content)``: overlapping windows of lines; blank ones are left out."""
    step = lines - min(overlap, lines - 1)
    n = "(size(ls) - if(element_at(ls, -1) = '', 1, 0))"
    windows = files.selectExpr("file_path", "language", "split(content, '\\n') as ls").selectExpr("file_path", "language", "ls", f"posexplode(sequence(0, cast(ceil(greatest({n} - {lines}, 0) / {step}) as int))) as (ordinal, i)")
    shaped = windows.selectExpr(
        "file_path", "language", "ordinal", f"cast(i * {step} + 1 as bigint) as start_line", f"cast(least(i * {step} + {lines}, {n}) as bigint) as end_line",
        f"array_join(slice(ls, i * {step} + 1, greatest(least(i * {step} + {lines}, {n}) - i * {step}, 0)), '\\n') as content",
    )
    return shaped.where(r"content rlike '\\S'")


def is_git_url(source: str) -> bool:
    return bool(re.match(r"(?:https?|ssh|git|git\+ssh|file)://", source)) or bool(re.match(r"[\w.-]+@[\w.-]+:(?!/)", source))


def clone(url: str, ref: str | None = None, offline: bool = False, into: str | None = None) -> str:
    """A shallow clone of a repository in a new folder, refused when offline; ``into`` must be shared where workers read it."""
    if offline:
        raise ValueError("Git sources need the network")
    target = tempfile.mkdtemp(prefix="quern-clone-", dir=into)
    subprocess.run(["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, target], check=True, capture_output=True)
    return target


def resolve_source(source: str, ref: str | None = None, offline: bool = False) -> tuple[str, str, str]:
    """``(kind, source, id)``: a repository's address, refused when offline, or the full path of a folder."""
    if is_git_url(source):
        if offline:
            raise ValueError("Git sources need the network")
        return "git", source, f"git:{source}" + (f"@{ref}" if ref else "")
    if not os.path.isdir(source):
        raise NotADirectoryError(source)
    path = os.path.realpath(source)
    return "path", path, f"path:{path}"

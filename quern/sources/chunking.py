"""Files into chunks along their own structure, with line windows for what has none.

A file's outline is a tree of spans: for Python that of its statements, for other code that of its indentation.  Spans are
packed into chunks of at most ``SIZE`` characters; a span that is larger is packed from its own parts, and a part without
parts is cut.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.tree import OVERLAP, WINDOW

SIZE = 1500

# Languages whose indentation follows their structure.
OUTLINED = {
    "javascript", "typescript", "rust", "go", "java", "c", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "scala", "bash", "sql", "lua", "elixir", "haskell", "zig", "python",
}
#: A line that ends or goes on with what the line above it at the same depth began.
_GOES_ON = re.compile(r"[)\]}>]|(?:end|else|elif|elsif|elseif|except|catch|finally|rescue|ensure|then|do|done|fi|esac|where|in)\b")

Span = tuple[int, int]


@dataclass
class Node:
    start: int
    end: int
    parts: list[Node] = field(default_factory=list)


def _edges(text: str) -> list[int]:
    """Where each line begins, and the end of the text."""
    return [0, *(m.end() for m in re.finditer("\n", text)), len(text)]


def _statements(text: str) -> Node | None:
    """The outline of Python source by its syntax tree; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    edges = _edges(text)

    def node(s: ast.AST) -> Node:
        first = min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", []))])
        made = Node(edges[first - 1], edges[s.end_lineno])
        inner = [x for name in ("body", "orelse", "handlers", "finalbody", "cases") for x in getattr(s, name, None) or [] if isinstance(x, (ast.stmt, ast.ExceptHandler))]
        if inner:
            nodes = [node(x) for x in inner]
            # What stands before the first statement inside, as the line that opens the block, is a part too.
            head = [Node(made.start, nodes[0].start)] if nodes[0].start > made.start else []
            made.parts = head + nodes
        return made

    return Node(0, len(text), [node(s) for s in tree.body])


def _indented(text: str) -> Node:
    """The outline by indentation: a line and the deeper lines after it are a span, the deeper ones are its parts."""
    edges = _edges(text)
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]

    def spans(first: int, last: int) -> list[Node]:
        known = [d for d in depth[first:last] if d >= 0]
        if not known:
            return []
        level, starts = min(known), []
        for i in range(first, last):
            if depth[i] >= 0 and (not starts or (depth[i] <= level and not _GOES_ON.match(lines[i].lstrip()))):
                starts.append(i)
        made = []
        for i, upto in zip(starts, [*starts[1:], last]):
            node = Node(edges[i], edges[min(upto, len(edges) - 1)])
            if upto - i > 1 and node.end - node.start > SIZE:
                inner = spans(i + 1, upto)
                if inner:
                    node.parts = [Node(edges[i], inner[0].start), *inner]
            made.append(node)
        return made

    return Node(0, len(text), spans(0, len(lines)))


def outline(text: str, language: str | None) -> Node | None:
    if language not in OUTLINED:
        return None
    return (_statements(text) if language == "python" else None) or _indented(text)


def slices(start: int, end: int, size: int) -> list[Span]:
    return [(a, min(a + size, end)) for a in range(start, end, size)]


def merged(groups: list[list[Span]], sizes: list[int], size: int) -> tuple[list[list[Span]], list[int]]:
    """Neighbouring groups joined while they stay below the size; where all that are left would fit, the last stays alone."""
    total = list(accumulate(sizes, initial=0))
    out, out_sizes, at = [], [], 0
    while at < len(groups):
        reached = bisect_left(total, total[at] + size, lo=at)
        upto = max(at + 1, min(reached, len(groups)) - 1)
        out.append([s for g in groups[at:upto] for s in g])
        out_sizes.append(total[upto] - total[at])
        at = upto
    return out, out_sizes


def packed(node: Node, size: int = SIZE) -> tuple[list[list[Span]], list[int]]:
    """``(groups, sizes)``: the node's parts in order, as many in a group as fit; larger parts are packed on their own."""
    if not node.parts:
        spans = slices(node.start, node.end, size) if node.end - node.start > size else [(node.start, node.end)]
        return [[s] for s in spans], [b - a for a, b in spans]
    groups: list[list[Span]] = []
    sizes: list[int] = []
    fresh = True
    for part in node.parts:
        n = part.end - part.start
        if n > size:
            inner, inner_sizes = packed(part, size)
            groups += inner
            sizes += inner_sizes
            fresh = True
        elif fresh or sizes[-1] + n > size:
            groups.append([(part.start, part.end)])
            sizes.append(n)
            fresh = False
        else:
            groups[-1].append((part.start, part.end))
            sizes[-1] += n
    return merged(groups, sizes, size)


def covering(groups: list[list[Span]], length: int) -> list[Span]:
    """The ranges of the groups: each reaches to where the next begins, the first begins and the last ends with the text."""
    starts = [0, *(g[0][0] for g in groups[1:])]
    return list(zip(starts, [*starts[1:], length])) if groups else []


def code_chunks(text: str, language: str | None, size: int = SIZE) -> list[tuple[int, int, str]]:
    """``(start_line, end_line, content)`` of the chunks; none without an outline or for a blank text."""
    node = outline(text, language) if text.strip() else None
    if node is None:
        return []
    edges = _edges(text)
    line = lambda at: bisect_left(edges, at + 1, hi=len(edges) - 1)
    ranges = covering(packed(node, size)[0], len(text))
    return [(line(a), line(max(b - 1, a)), text[a:b]) for a, b in ranges if text[a:b].strip()]


def window_chunks(text: str, lines: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """The same from windows of lines, for texts without an outline."""
    kept = text.split("\n")[: -1 if text.endswith("\n") else None]
    step = lines - min(overlap, lines - 1)
    starts = range(0, max(len(kept) - lines, 0) + step, step) if kept else ()
    made = [(i + 1, min(i + lines, len(kept)), "\n".join(kept[i : i + lines])) for i in starts]
    return [m for m in made if m[2].strip()]


def chunk_files(files: DataFrame, size: int = SIZE) -> DataFrame:
    """``(file_path, language, ordinal, start_line, end_line, content, outlined)`` of ``(file_path, language, content)``.

    A null content has no chunks.  ``outlined`` says whether a chunk follows the file's structure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = code_chunks(text or "", language, size)
                rows += [(path, language, i, a, b, t, bool(found)) for i, (a, b, t) in enumerate(found or window_chunks(text or ""))]
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            names = ["file_path", "language", "ordinal", "start_line", "end_line", "content", "outlined"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "file_path string, language string, ordinal int, start_line bigint, end_line bigint, content string, outlined boolean"
    return files.select("file_path", "language", "content").mapInArrow(run, schema)

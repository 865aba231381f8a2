"""Results as text and JSON lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable


def truncate(text: str, letters: int) -> str:
    return text[:letters]


def estimate_tokens(text: str) -> int:
    """White-space separated words, at least one."""
    return max(1, len(text.split()))


def fenced(content: str, language: str = "") -> str:
    """A code block whose fence is longer than any run of backticks inside."""
    fence = "`" * max(3, 1 + max(map(len, re.findall("`+", content)), default=0))
    return f"{fence}{language}\n{content}\n{fence}"


def location(row) -> str:
    return f"{row.file_path}:{row.start_line}-{row.end_line}"


def languages(counts: dict[str, int]) -> str:
    return ", ".join(f"{k} {n}" for k, n in sorted(counts.items())) or "none"


def results(header: str, rows: Iterable, source: str) -> str:
    """A heading per hit with its place, score and source, and its content as a code block."""
    parts = [header, ""]
    for i, r in enumerate(rows, 1):
        parts += [f"## {i}. {location(r)}  [score={r.score:.3f}, source={source}]", fenced(r.content.strip()), ""]
    return "\n".join(parts)


def compact(rows: Iterable) -> str:
    return "\n".join(f"{location(r)}\t{r.score:.3f}" for r in rows)


def json_lines(rows: Iterable) -> str:
    return "\n".join(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in rows)

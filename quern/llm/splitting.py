"""Problem 2: chunks above a size limit in pieces, cut at natural boundaries, with repeated lines between pieces.

Boundaries are the line starts of a text, ranked by how natural a cut there is, and places within lines that are too long
themselves.  An as-of join gives every boundary the farthest legal successor: the next piece begins ``OVERLAP`` lines
earlier and must end within the limit.  Squaring the successor table doubles the cuts that are known from the first
boundary of every chunk, so all cuts are found after the logarithm of the longest chunk's number of pieces.  Boundaries
of different chunks never meet, so the tables are arrays over all chunks of a batch, and no boundary is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import block_starts, language_of

LIMIT = 1500
OVERLAP = 5
#: Ranks of a boundary: within a line, at a line, after a blank line, at the start of a block, at the end of the text.
INSIDE, LINE, BLANK, BLOCK, END = 0, 1, 2, 3, 4


def boundaries_of(content: str, blocks: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """``(offset, rank, line, begin)`` of all boundaries in order, the end of the text last.

    ``begin`` is where a piece begins whose new text starts there: up to ``overlap`` lines earlier, as long as that leaves
    room for the text up to the next boundary.
    """
    lines = content.split("\n")
    edges = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
    ends = len(content)
    starts = set(blocks)
    found: list[tuple[int, int, int]] = []
    for i, x in enumerate(lines):
        if edges[i] >= ends and i:
            break
        found.append((edges[i], BLOCK if i in starts else BLANK if i and not lines[i - 1].strip() else LINE, i))
        if len(x) + 1 > limit:
            # About every twelfth of the limit a place after a separator, else anywhere.
            step, at = max(1, limit // 12), 0
            while at + step < len(x):
                window = x[at + 1 : at + step + 1]
                last = max((window.rfind(c) for c in " ;,}])\t"), default=-1)
                at += last + 2 if last >= 0 else step
                if at < len(x):
                    found.append((edges[i] + at, INSIDE, i))
    made = []
    for k, (offset, rank, line) in enumerate(found):
        after = found[k + 1][0] if k + 1 < len(found) else ends
        begin = offset
        if rank != INSIDE and line:
            for h in range(min(overlap, line), 0, -1):
                if after - edges[line - h] <= limit:
                    begin = edges[line - h]
                    break
        made.append((offset, rank, line, begin))
    return [*made, (ends, END, max(0, len(lines) - (2 if content.endswith("\n") else 1)), ends)]


def successors(base: np.ndarray, offset: np.ndarray, rank: np.ndarray, begin: np.ndarray, limit: int) -> np.ndarray:
    """The place in the table of the cut that follows each boundary; the end of a text follows itself.

    ``base`` sets the texts so far apart that no reach leads into the next one.  The farthest boundary within reach of
    the highest rank follows, as long as the piece keeps a quarter of the limit of new text; else the farthest of the
    next lower rank.
    """
    at, reach = base + offset, base + begin + limit
    following = at.copy()
    for r in (INSIDE, LINE, BLANK, BLOCK):
        places = at[rank >= r]
        far = places[np.maximum(np.searchsorted(places, reach, side="right") - 1, 0)]
        good = far > at if r < BLANK else far >= at + limit // 4
        following = np.where(good & (far <= reach), far, following)
    return np.where(rank == END, np.arange(len(at)), np.searchsorted(at, following))


def cuts(following: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which boundaries are reached from the ``first`` ones, by squaring the successor table."""
    reached = np.zeros(len(following), dtype=bool)
    reached[first] = True
    while True:
        reached[following[reached]] = True
        further = following[following]
        if (further == following).all():
            return reached
        following = further


#: A piece: its new text from ``at`` to ``next``, its content from ``begin`` on, its lines in the file, the lines that it
#: repeats and the lines at which a block starts in its new text.
SPAN = "at:bigint, next:bigint, start_line:bigint, end_line:bigint, repeated_lines:bigint, block_lines:array<bigint>"


def _pieces_of(texts: list[str], languages: list, paths: list, firsts: list[int], limit: int, overlap: int, contents: bool) -> pa.ListArray:
    tables = [np.array(boundaries_of(t, block_starts(t, language_of(k, p)), limit, overlap), dtype=np.int64) for t, k, p in zip(texts, languages, paths)]
    sizes = np.array([len(t) for t in tables])
    offset, rank, line, begin = np.concatenate(tables).T
    which = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    apart = np.cumsum(lengths + limit + 1) - (lengths + limit + 1)
    following = successors(apart[which], offset, rank, begin, limit)
    cut_at = np.flatnonzero(cuts(following, starts) & (rank != END))
    ends, owner = following[cut_at], which[cut_at]
    at, upto = offset[cut_at], offset[ends]
    begin_line = line[np.searchsorted(apart[which] + offset, apart[owner] + begin[cut_at])]
    # A piece that ends before a line's first letter ends with the line above it.
    above = np.fromiter((n < len(texts[o]) and texts[o][n - 1] == "\n" for o, n in zip(owner, upto)), dtype=bool, count=len(owner))
    file_line = np.array(firsts, dtype=np.int64)
    blocks = np.flatnonzero(rank == BLOCK)
    holder = np.searchsorted(cut_at, blocks, side="right") - 1
    edges = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=len(cut_at)))]).astype(np.int32)
    columns = {
        "at": pa.array(at), "next": pa.array(upto), "start_line": pa.array(file_line[owner] + begin_line), "end_line": pa.array(file_line[owner] + line[ends] - above), "repeated_lines": pa.array(line[cut_at] - begin_line),
        "block_lines": pa.ListArray.from_arrays(edges, pa.array(file_line[which[blocks]] + line[blocks])),
    }
    if contents:
        columns["content"] = pa.array([texts[o][b:n] for o, b, n in zip(owner, begin[cut_at], upto)], pa.string())
    counts = np.bincount(owner, minlength=len(texts))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _split(names: list[str], limit: int, overlap: int, contents: bool, letters: int = 8_000_000):
    """Rows of ``names`` with their pieces; the first four are the content, the language, the path and the first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages, paths, firsts = (batch.column(i).to_pylist() for i in range(4))
            sizes = np.cumsum([len(t) for t in texts])
            edges = [0, *(np.flatnonzero(np.diff(sizes // letters)) + 1).tolist(), len(texts)] if texts else []
            for a, b in zip(edges, edges[1:]):
                pieces = _pieces_of(texts[a:b], languages[a:b], paths[a:b], firsts[a:b], limit, overlap, contents)
                digests = pa.array([xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(1, len(names))), digests, pieces], names=[*names[1:], "digest", "pieces"])

    return run


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The chunks with more code points than the limit.  Null contents and rows without a key are left out."""
    return chunks.where(F.col("chunk_id").isNotNull() & (F.char_length("content") > limit))


def pieces_by_chunk(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, contents: bool = True) -> DataFrame:
    """One row per oversized chunk: ``(chunk_id, file_path, language, first_line, symbols, breadcrumbs, pieces)``.

    Repeated rows of a chunk count once; where they differ the one indexed last holds, then the one with the greater
    digest.  A null start_line is 1.  ``contents`` says whether the pieces carry their text or only where they lie.
    """
    if limit < 12:
        raise ValueError("limit must be at least 12")
    carried = ["symbols", "breadcrumbs"] if contents else []
    first = F.coalesce("start_line", F.lit(1)).cast("bigint").alias("first_line")
    rows = oversized(chunks, limit).select("content", "language", "file_path", first, "chunk_id", "indexed_at", *carried)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    span = SPAN + (", content:string" if contents else "")
    made = rows.mapInArrow(_split(rows.columns, limit, overlap, contents), ", ".join(f"{n} {kinds[n]}" for n in rows.columns[1:]) + f", digest binary, pieces array<struct<{span}>>")
    row = ["file_path", "language", "first_line", *carried, "pieces"]
    return made.groupBy("chunk_id").agg(F.max(F.struct("indexed_at", "digest", *row)).alias("_r")).select("chunk_id", *(f"_r.{c}" for c in row))


def block_lines(split: DataFrame) -> DataFrame:
    """``(chunk_id, line)``: the file's lines at which a top-level block starts, from the pieces of oversized chunks."""
    return split.select("chunk_id", F.explode(F.flatten("pieces.block_lines")).alias("line"))


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(chunk_id, file_path, language, piece, content, start_line, end_line, breadcrumbs, repeated_lines)`` of the oversized chunks.

    Every piece has at most ``limit`` code points; put together without their repeated lines the pieces are the chunk.
    Lines are those of the file.  A breadcrumb that names a symbol of the chunk goes to the pieces that hold the symbol's
    line, any other to all pieces; null breadcrumbs become an empty list.
    """
    rows = pieces_by_chunk(chunks, limit, overlap).select("chunk_id", "file_path", "language", "symbols", "breadcrumbs", F.posexplode("pieces").alias("piece", "p"))
    shaped = rows.select("chunk_id", "file_path", "language", "piece", "p.content", "p.start_line", "p.end_line", "symbols", "breadcrumbs", "p.repeated_lines")
    kept = F.expr(
        "filter(coalesce(breadcrumbs, array()), b -> not exists(coalesce(symbols, array()), s -> concat(s.kind, ' ', s.name) = b)"
        " or exists(symbols, s -> concat(s.kind, ' ', s.name) = b and s.line between start_line and end_line))"
    )
    return shaped.select("chunk_id", "file_path", "language", "piece", "content", "start_line", "end_line", kept.alias("breadcrumbs"), "repeated_lines")

"""Problem 8: byte-level BPE of whole texts with the files of a public tokenizer.

A text is cut into words by the tokenizer's pattern.  Words repeat, so each batch of rows encodes only the words it has
not met: their bytes become rows ``(word, pos, id)`` of an embedded SQL engine, whose recursive query joins neighbours
to the merge table and contracts the pairs of minimum rank of every word until no word has a pair left.  An ordered
aggregation turns the rows back into one list of ids per word, and the lists are strung together per text.

Long words are taken in windows, so that neither time nor memory grows faster than the word.  Tokens are those of the
whole word if and only if every two neighbours are what their joined bytes encode to, so only the seams between windows
are looked at, and the tokens around a seam that does not hold are encoded again, in growing reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer lies on every host.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the word pattern of the byte-level tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The words one worker keeps; beyond it the store starts afresh, which costs time only.
CACHED_WORDS = 1_000_000

#: Words of one recursive query, by their bytes, so that its rows fit in memory.
BYTES_A_QUERY = 700_000

#: Words of at most so many bytes take one contraction a step, the leftmost; the row's index and its successor's id are
#: kept up in place, so that a step joins only the merge table and each word's best pair.
SHORT = 48
#: The same query takes the windows and seams of longer words up to so many bytes.
LONGEST = 255

_LEFTMOST = """
WITH RECURSIVE step(word, i, id, next_id, done) AS (
  SELECT word, pos, id, next_id, false FROM seed
  UNION ALL
  (
    WITH live AS (
      SELECT word, i, id, next_id FROM step WHERE NOT done
    ), best AS (
      SELECT l.word, min((m.rank * 256 + l.i) * 131072 + m.merged) AS b
      FROM live l JOIN merges m ON m.pair = l.id::BIGINT * 131072 + l.next_id WHERE l.next_id >= 0 GROUP BY l.word
    ), hit AS (
      SELECT word, ((b // 131072) % 256)::INT AS h, (b % 131072)::INT AS merged FROM best
    )
    SELECT l.word, CASE WHEN l.i > h THEN l.i - 1 ELSE l.i END, CASE WHEN l.i = h + 1 THEN merged ELSE l.id END,
           CASE WHEN l.i = h - 1 THEN merged ELSE l.next_id END, h IS NULL
    FROM live l LEFT JOIN hit USING (word) WHERE h IS NULL OR l.i <> h
  )
)
SELECT word, list(id ORDER BY i) AS ids FROM step WHERE done GROUP BY word ORDER BY word
"""

#: Bytes of the windows that longer words are taken in.
WINDOW = 32

#: One step over pieces that are too long for the indices above: all pairs of a piece's minimum rank are contracted, from
#: the left, every second one within a run of overlapping pairs.  That equals taking the leftmost again and again, as a
#: pair that a contraction creates always has a higher rank than the contraction itself.
_ALL_LEAST = """
CREATE OR REPLACE TEMP TABLE later AS
WITH pairs AS (
  SELECT word, pos, id, lead(id) OVER w AS next_id, row_number() OVER w AS i FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
), ranked AS (
  SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.word) AS least
  FROM pairs p LEFT JOIN merges m ON m.pair = p.id::BIGINT * 131072 + p.next_id
), hits AS (
  SELECT *, CASE WHEN rank = least THEN i - row_number() OVER (PARTITION BY word, rank = least ORDER BY i) END AS run FROM ranked
), chosen AS (
  SELECT *, run IS NOT NULL AND (row_number() OVER (PARTITION BY word, run ORDER BY i)) % 2 = 1 AS here FROM hits
), shifted AS (
  SELECT *, lag(here, 1, false) OVER (PARTITION BY word ORDER BY i) AS eaten FROM chosen
)
SELECT word, pos, CASE WHEN here THEN merged ELSE id END AS id FROM shifted WHERE NOT eaten
"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, the others from 256 up."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids of the 256 bytes, merges as rows a, b, rank, merged)`` of a tokenizer file; bounded by its vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    of_byte = np.zeros(256, dtype=np.int32)
    for letter, byte in byte_letters().items():
        of_byte[byte] = vocab[letter]
    rows = []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        rows.append((vocab[a], vocab[b], rank, vocab[a + b]))
    return of_byte, np.array(rows, dtype=np.int32)


class _Codes(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _take(starts: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, values)`` of the lists ``which``, strung together; list i is ``values[starts[i]:starts[i + 1]]``."""
    begins, sizes = starts[which], starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    return ends, values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)]


class WordEncoder:
    """Ids of texts; the words are encoded by recursive SQL and remembered.

    Between two words a text is first cut where white space follows something else, which the pattern never spans; such
    segments repeat as words do and save most of the pattern matching.
    """

    def __init__(self, of_byte: np.ndarray, merges: np.ndarray) -> None:
        import duckdb

        if len(merges) and merges.max() >= 131072:
            raise ValueError("ids and ranks must be below 131072")
        # Without a folder to spill to: what a query holds is bounded by BYTES_A_QUERY or the longest piece.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.of_byte = of_byte
        self.token_bytes: dict[int, bytes] = {int(t): bytes([b]) for b, t in enumerate(of_byte)}
        for x, y, _, merged in merges.tolist():
            self.token_bytes[merged] = self.token_bytes[x] + self.token_bytes[y]
        # Whether some token holds the two bytes side by side; elsewhere a word can be cut without changing its tokens.
        self.joined = np.zeros(65536, dtype=bool)
        for t in self.token_bytes.values():
            for x, y in zip(t, t[1:]):
                self.joined[x * 256 + y] = True
        wide = merges.astype(np.int64)
        merge_rows = pa.table({"pair": wide[:, 0] * 131072 + wide[:, 1], "rank": wide[:, 2], "merged": wide[:, 3]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.words = regex.compile(WORD).findall
        self.segments = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+").findall
        self.odd_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.clear()

    def clear(self) -> None:
        self.codes, self.word_codes = _Codes(), _Codes()
        self.ids, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.word_ids, self.word_starts = self.ids, self.starts
        self.pieces: dict[bytes, np.ndarray] = {}
        self.holds: dict[int, bool] = {}

    def solve(self, raw: list[bytes], short: bool) -> list[np.ndarray]:
        """The ids of the pieces."""
        sizes = np.array([len(r) for r in raw])
        ids = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        follow = np.append(ids[1:], -1)
        follow[np.cumsum(sizes) - 1] = -1
        seed = pa.table(  # noqa: F841
            {
                "word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
                "pos": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
                "id": ids,
                "next_id": follow.astype(np.int32),
            }
        )
        if short:
            found = self.db.sql(_LEFTMOST)
        else:
            # Only the last step is kept.
            self.db.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT word, pos, id FROM seed")
            rows, left = int(sizes.sum()) + 1, int(sizes.sum())
            while left < rows:
                rows, left = left, self.db.execute(_ALL_LEAST).fetchone()[0]
                self.db.execute("DROP TABLE state; ALTER TABLE later RENAME TO state")
            found = self.db.sql("SELECT word, list(id ORDER BY pos) AS ids FROM state GROUP BY word ORDER BY word")
        lists = found.to_arrow_table()["ids"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        return np.split(lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int32), (offsets - offsets[0])[1:-1])

    def encode_pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of byte strings, of which each distinct one is encoded once."""
        new = list(dict.fromkeys(r for r in raw if r not in self.pieces))
        for short in (True, False):
            part = [r for r in new if (len(r) <= LONGEST) == short]
            self.pieces.update(zip(part, self.solve_all(part, short)))
        return [self.pieces[r] for r in raw]

    def solve_all(self, raw: list[bytes], short: bool) -> Iterator[np.ndarray]:
        edges = (np.flatnonzero(np.diff(np.cumsum([len(r) for r in raw]) // BYTES_A_QUERY)) + 1).tolist() if raw else []
        for a, b in zip([0, *edges], [*edges, len(raw)] if raw else []):
            yield from self.solve(raw[a:b], short)

    def torn(self, ids: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Of the gaps after the tokens ``gaps`` those whose two tokens are not what their joined bytes encode to."""
        pair = ids[gaps].astype(np.int64) * 131072 + ids[gaps + 1]
        new = [p for p in np.unique(pair).tolist() if p not in self.holds]
        for p, got in zip(new, self.encode_pieces([self.token_bytes[p // 131072] + self.token_bytes[p % 131072] for p in new])):
            self.holds[p] = len(got) == 2 and got[0] == p // 131072 and got[1] == p % 131072
        return gaps[[not self.holds[p] for p in pair.tolist()]] if len(gaps) else gaps

    def encode_long(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of long words, by windows and mended seams."""
        windows, owner, seams = [], [], []
        for w, r in enumerate(raw):
            b = np.frombuffer(r, dtype=np.uint8).astype(np.int64)
            edges = [0, *(np.flatnonzero(~self.joined[b[:-1] * 256 + b[1:]]) + 1).tolist(), len(r)]
            for x, y in zip(edges, edges[1:]):
                for z in range(x, y, WINDOW):
                    windows.append(r[z : min(y, z + WINDOW)])
                    owner.append(w)
                    seams.append(z + WINDOW < y)
        lists = self.encode_pieces(windows)
        sizes = np.array([len(x) for x in lists])
        ids, word = np.concatenate(lists), np.repeat(owner, sizes)
        gaps, reach = (np.cumsum(sizes) - 1)[np.array(seams)], 4
        while len(torn := self.torn(ids, gaps)):
            low = np.maximum(torn - reach + 1, np.searchsorted(word, word[torn]))
            high = np.minimum(torn + reach + 1, np.searchsorted(word, word[torn], side="right"))
            # Regions that overlap are one.
            first = np.flatnonzero(np.concatenate([[True], low[1:] >= np.maximum.accumulate(high)[:-1]]))
            low, high = low[first], np.maximum.reduceat(high, first)
            mended = self.encode_pieces([b"".join(self.token_bytes[t] for t in ids[x:y].tolist()) for x, y in zip(low, high)])
            sizes = np.array([len(x) for x in mended])
            moved = np.cumsum(sizes - (high - low))
            kept = np.ones(len(ids), dtype=bool)
            for x, y in zip(low, high):
                kept[x:y] = False
            begin, own = low + moved - (sizes - (high - low)), word[low]
            order = np.argsort(np.concatenate([np.flatnonzero(kept), np.repeat(low, sizes)]), kind="stable")
            ids = np.concatenate([ids[kept], *mended])[order]
            word = np.concatenate([word[kept], np.repeat(own, sizes)])[order]
            gaps = np.unique(np.concatenate([begin - 1, begin + sizes - 1]))
            gaps = gaps[(gaps >= 0) & (gaps + 1 < len(ids))]
            gaps, reach = gaps[word[gaps] == word[gaps + 1]], reach * 8
        return np.split(ids, np.searchsorted(word, np.arange(1, len(raw))))

    def learn_words(self, words: list[str]) -> None:
        """Encode new words; their lists follow on those of the words met before."""
        raw = [w.encode("utf-8", "replace") for w in words]
        parts: list = [None] * len(raw)
        short, long = [i for i, r in enumerate(raw) if len(r) <= SHORT], [i for i, r in enumerate(raw) if len(r) > SHORT]
        for i, ids in zip(short, self.solve_all([raw[i] for i in short], True)):
            parts[i] = ids
        for i, ids in zip(long, self.encode_long([raw[i] for i in long]) if long else ()):
            parts[i] = ids
        self.word_ids = np.concatenate([self.word_ids, *parts]).astype(np.int32)
        self.word_starts = np.concatenate([self.word_starts, self.word_starts[-1] + np.cumsum([len(x) for x in parts])])

    def learn(self, segments: list[str]) -> None:
        known, code = len(self.word_codes), self.word_codes.__getitem__
        counts, flat = [], []
        for s in segments:
            found = self.words(s)
            counts.append(len(found))
            flat.extend(map(code, found))
        if len(self.word_codes) > known:
            self.learn_words(list(self.word_codes)[known:])
        ends, ids = _take(self.word_starts, self.word_ids, np.array(flat, dtype=np.int64))
        edges = np.concatenate([[0], ends])[np.cumsum(counts)]
        self.starts = np.concatenate([self.starts, self.starts[-1] + edges])
        self.ids = np.concatenate([self.ids, ids]).astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of the texts: those of text i are ``ids[offsets[i]:offsets[i + 1]]``."""
        if max(len(self.codes), len(self.pieces)) > CACHED_WORDS:
            self.clear()
        code, known, rows = self.codes.__getitem__, len(self.codes), []
        for text in texts:
            cut = () if not text else self.words(text) if self.odd_space(text) else self.segments(text)
            rows.append(np.fromiter(map(code, cut), dtype=np.int64, count=len(cut)))
        if len(self.codes) > known:
            self.learn(list(self.codes)[known:])
        ends, ids = _take(self.starts, self.ids, np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64))
        edges = np.concatenate([[0], ends])
        return edges[np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])], ids


def _slices(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` letters, so that memory does not follow the batch."""
    start = taken = 0
    for i, t in enumerate(texts):
        taken += len(t or "")
        if taken >= limit:
            yield start, i + 1
            start, taken = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _over_batches(key: str, path: str, finish: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                encoder = encoder or WordEncoder(*load_merges(path))
                offsets, ids = encoder.encode(texts[a:b])
                yield finish(batch.column(key).slice(a, b - a), offsets, ids)

    return run


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, ids)``: the ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text; an empty and a null text give an empty list.  Letters that
    UTF-8 cannot hold become ``?``.  Rows are neither merged nor dropped: a repeated row comes out as often.
    """

    def finish(keys: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets.astype(np.int32), ids)], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text).alias("text")).mapInArrow(_over_batches(key, tokenizer, finish), f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, tokens)``: the number of ids of every text; 0 for an empty or null one."""

    def finish(keys: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets), pa.int64())], names=[key, "tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text).alias("text")).mapInArrow(_over_batches(key, tokenizer, finish), f"`{key}` {kind}, tokens bigint")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, text)``: the texts of lists of ids; an empty list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = byte_letters()
        with open(tokenizer, encoding="utf-8") as f:
            pieces = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if all(c in letters for c in t)}
        for batch in batches:
            texts = [None if row is None else b"".join(pieces[i] for i in row).decode("utf-8", "replace") for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")

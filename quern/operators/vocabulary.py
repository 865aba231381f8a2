"""Tokens of many texts at once, as numbers.

Words, their parts, tokens and short texts are numbered in the order in which they are met, so what is the same for all
texts is found once and kept in lists of numbers, and a text's tokens are looked up and made distinct in arrays.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from quern.functions.text import IDENTIFIER
from quern.operators.encoders import _variants

_words = re.compile(IDENTIFIER).findall
#: Pairs of a row and a number are one number, the row above these bits.
BITS, LOW = 32, (1 << 32) - 1


class Numbers(dict):
    """Numbers in the order of first meeting; ``new`` has what was met since it was last taken."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, x: str | None) -> int:
        self[x] = n = len(self)
        self.new.append(x)
        return n

    def of(self, some, count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.int64, count)

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


class Lists:
    """Lists of numbers, by number."""

    def __init__(self) -> None:
        self.ends, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of some lists, and the lists one after the other."""
        sizes = self.ends[at + 1] - self.ends[at]
        before = np.cumsum(sizes) - sizes
        return sizes, self.flat[np.arange(sizes.sum()) + np.repeat(self.ends[at] - before, sizes)]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) > 0]


def cut_by_case(text: str) -> str:
    """A space where an identifier changes from small to capital letters or digits, from digits to letters, and before the last of
    several capitals that small letters follow."""
    b = np.frombuffer(text.encode(), np.uint8)
    small, capital, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    at = small[:-1] & (capital | digit)[1:] | digit[:-1] & (small | capital)[1:]
    at[:-1] |= capital[:-2] & capital[1:-1] & small[2:]
    return np.insert(b, np.flatnonzero(at) + 1, 32).tobytes().decode()


class Vocabulary:
    """``asked`` has the codes of the tokens asked for, ``watched`` words to look out for, in lower case."""

    def __init__(self, asked: dict[str, int], dimensions: int, watched: dict[str, list]) -> None:
        self.asked, self.dimensions, self.watched = asked, dimensions, watched
        self.words, self.parts, self.tokens, self.pieces = Numbers(), Numbers(), Numbers(), Numbers()
        self.of_word, self.of_part, self.of_piece = Lists(), Lists(), Lists()
        #: Of every token the code, -1 where it is not asked for, and its place and sign in a vector.
        self.code, self.place, self.sign = (np.zeros(0, dtype=np.int64) for _ in range(3))
        #: Whether a word is looked out for, and those that are, in lower case.
        self.is_watched, self.met = np.zeros(0, dtype=bool), {}

    def __len__(self) -> int:
        return max(len(self.words), len(self.pieces))

    def distinct_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words, and the distinct tokens, of some texts, each with its text's place."""
        found = [_words(t) if t else () for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        numbers = self.words.of(chain.from_iterable(found), sizes.sum())
        self._learn_words()
        words = distinct(np.repeat(np.arange(len(texts)), sizes) << BITS | numbers)
        sizes, tokens = self.of_word.of(words & LOW)
        return words, distinct(np.repeat(words >> BITS, sizes) << BITS | tokens)

    def numbered(self, strings: pa.Array) -> np.ndarray:
        """The numbers of short texts."""
        coded = strings.dictionary_encode()
        known = coded.dictionary.to_pylist()
        return self.pieces.of([*known, None], len(known) + 1)[coded.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]

    def learn_pieces(self) -> None:
        new = self.pieces.taken()
        if new:
            _, tokens = self.distinct_of(new)
            self.of_piece.add(np.bincount(tokens >> BITS, minlength=len(new)), tokens & LOW)

    def _learn_words(self) -> None:
        new = self.words.taken()
        if not new:
            return
        text, first = "\n".join(new), len(self.is_watched)
        lows = text.lower().split("\n")
        split = [[low, *(low.replace("_", " ") if "_" in low else cut).split()] for low, cut in zip(lows, cut_by_case(text).lower().split("\n"))]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        parts = self.parts.of(chain.from_iterable(split), sizes.sum())
        self._learn_parts()
        many, tokens = self.of_part.of(parts)
        self.of_word.add(np.add.reduceat(many, np.cumsum(sizes) - sizes), tokens)
        self.is_watched = np.concatenate([self.is_watched, np.fromiter(map(self.watched.__contains__, lows), bool, len(lows))])
        self.met.update((first + int(i), lows[i]) for i in np.flatnonzero(self.is_watched[first:]))

    def _learn_parts(self) -> None:
        new = [_variants(p) for p in self.parts.taken()]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        self.of_part.add(sizes, self.tokens.of(chain.from_iterable(new), sizes.sum()))
        tokens = self.tokens.taken()
        self.code = np.concatenate([self.code, np.fromiter((self.asked.get(t, -1) for t in tokens), np.int64, len(tokens))])
        if self.dimensions:
            digests = np.frombuffer(b"".join([hashlib.md5(t.encode()).digest() for t in tokens]), np.uint8).reshape(-1, 16)
            self.place = np.concatenate([self.place, np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0].astype(np.int64) % self.dimensions])
            self.sign = np.concatenate([self.sign, np.where(digests[:, 4] < 128, 1, -1)])

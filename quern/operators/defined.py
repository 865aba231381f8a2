"""Which of a batch's names a chunk defines, found where the chunk is read.

A definition holds every word of the name it defines as a word of its own, so only chunks with the longest of them are
looked at, and of those only the ones where a word that introduces definitions stands before the name.
"""

from __future__ import annotations

import re

import pyarrow as pa

from quern.functions.text import IDENTIFIER

#: A definition is three times the name's code, and 1 more if the name, 2 more if its last part is a word of a public file.
CODES = 4

_runs = re.compile("[A-Za-z0-9_]+").findall
_before = re.compile(r"([A-Za-z]+)\s+[A-Za-z0-9_.:]*[$]?\Z", re.ASCII)
_unclear = re.compile(r"[A-Za-z0-9_.:$\s]*\Z", re.ASCII)
#: As far as is looked back for the word before a name; where that does not tell, the pattern does.
BACK = 200


def leaf(name: str) -> str:
    """The last part of a name by the first kind of separator it has."""
    return next((name.split(s)[-1] for s in ("::", "\\", "->", ".") if s in name), name)


class Definitions:
    """Finds ``names``, which have their codes."""

    def __init__(self, names: dict[str, int]) -> None:
        from quern.functions.classify import PUBLIC_STEMS
        from quern.plans.stages import DEFINERS, SQL_DEFINERS

        self.words, self.sql_words = "|".join(DEFINERS), "|".join(SQL_DEFINERS)
        self.last = {w.split()[-1].lower() for w in (*DEFINERS, *SQL_DEFINERS)}
        self.public = set(re.findall(r"\w+", PUBLIC_STEMS))
        self.watched: dict[str, list[tuple[str, int]]] = {}
        for name, code in names.items():
            found = re.findall(IDENTIFIER, name)
            if found:
                self.watched.setdefault(max(found, key=len).lower(), []).append((name, code))
        self.patterns: dict[str, tuple[re.Pattern, re.Pattern]] = {}

    def _pattern(self, name: str) -> tuple[re.Pattern, re.Pattern]:
        made = self.patterns.get(name)
        if made is None:
            of = lambda words, flags: re.compile(rf"(?:^|\s)(?:{words})\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*\$?{re.escape(name)}(?:\s|[<({{:\[;]|$)", re.M | re.ASCII | flags)
            self.patterns[name] = made = (of(self.words, 0), of(self.sql_words, re.I))
        return made

    def _introduced(self, text: str, low: str, name: str) -> bool:
        """Whether a word that introduces definitions may stand before the name."""
        name, p = name.lower(), -1
        while (p := low.find(name, p + 1)) >= 0:
            end = p + len(name)
            if (end == len(text) or text[end] in " \t\n\r\f\v<({:[;") and p and text[p - 1] in " \t\n\r\f\v.:$":
                near = text[max(0, p - BACK) : p]
                before = _before.search(near)
                if before and before[1].lower() in self.last or p > BACK and (_unclear.match(near) or before and before.start() == 0):
                    return True
        return False

    def one(self, text: str, stem: str, names: list[tuple[str, int]]) -> list[int]:
        low = text.lower() if text.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), text)
        public, words, found = stem.lower() in self.public, None, []
        for name, code in names:
            exact, free = self._pattern(name)
            if not (self._introduced(text, low, name) and (exact.search(text) or free.search(text))):
                if not public or not any("pub use" in x and name in _runs(x) for x in text.split("\n")):
                    continue
            if public and words is None:
                words = set(_runs(text))
            found.append(CODES * code + (public and (name in words) + 2 * (leaf(name) in words)))
        return found

    def of(self, met: dict[int, list[str]], paths: list[str], texts: pa.Array) -> pa.Array:
        """The definitions of every chunk; ``met`` has the watched words of the chunks that hold any, in lower case."""
        if not self.watched:
            return pa.nulls(len(texts), pa.list_(pa.int32()))
        rows: list[list[int]] = [[] for _ in range(len(texts))]
        for i, words in met.items():
            names = {n: c for w in words for n, c in self.watched[w]}
            rows[i] = self.one(texts[i].as_py(), re.sub(r"^(.+)[.][^.]*$", r"\1", paths[i].split("/")[-1]), list(names.items()))
        return pa.array(rows, pa.list_(pa.int32()))

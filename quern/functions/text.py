"""Token and path functions as SQL expressions, for either dialect.

Every function takes and returns SQL text, so that expressions nest inside higher-order functions and stay in the JVM.
"""

from __future__ import annotations

from quern.functions.dialect import Spark

# Fixed values of the tokenizer.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
SYNONYMS = {
    "auth": "authentication", "authentication": "auth", "config": "configuration", "configuration": "config", "ctx": "context", "context": "ctx",
    "req": "request", "request": "req", "resp": "response", "response": "resp",
}
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "has", "have", "how", "if", "in", "is", "it", "not", "of", "on", "or", "the", "to", "was", "what", "when",
    "where", "which", "who", "why", "with",
)


def stop_list() -> str:
    return "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def identifier_parts(d: Spark, token: str) -> str:
    """The lower-cased token and its parts, cut at underscores or, without any, at changes of case and digits."""
    parts = f"CASE WHEN contains({token}, '_') THEN {d.split(f'lower({token})', '_')} ELSE {d.replace_camel(token)} END"
    return d.distinct(d.cat(d.array(f"lower({token})"), d.filter(parts, "q", "q <> ''")))


def variants(d: Spark, t: str) -> str:
    """A token with its plain stems, spellings and synonyms."""
    n = f"length({t})"
    when = lambda least, end, result: f"CASE WHEN {n} > {least} AND {d.ends(t, f"'{end}'")} THEN {result} END"
    items = [
        t,
        when(4, "ies", f"concat(left({t}, {n} - 3), 'y')"),
        when(4, "es", f"left({t}, {n} - 2)"),
        when(3, "s", f"left({t}, {n} - 1)"),
        when(5, "ing", f"left({t}, {n} - 3)"),
        when(5, "ing", f"concat(left({t}, {n} - 3), 'e')"),
        when(4, "ed", f"left({t}, {n} - 2)"),
        when(4, "ed", f"concat(left({t}, {n} - 2), 'e')"),
        f"CASE WHEN contains({t}, 'serialis') THEN replace({t}, 'serialis', 'serializ') END",
        f"CASE WHEN contains({t}, 'serializ') THEN replace({t}, 'serializ', 'serialis') END",
        f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + " END",
    ]
    return d.filter(d.array(*items), "v", "v IS NOT NULL AND v <> ''")


def tokens(d: Spark, text: str) -> str:
    """The distinct tokens of a text; of a null text an empty array."""
    raw = d.distinct(d.all_matches(f"coalesce({text}, '')", IDENTIFIER))
    parts = d.distinct(f"flatten({d.map(raw, 'r', identifier_parts(d, 'r'))})")
    return d.distinct(f"flatten({d.map(parts, 't', variants(d, 't'))})")


def basename(d: Spark, path: str) -> str:
    return d.at(d.split(path, "/"), "-1")


def stem(d: Spark, path: str) -> str:
    """The file name without its last extension; a leading dot begins no extension."""
    return d.replace_all(basename(d, path), "^(.+)[.][^.]*$", "\\1")


def directories(d: Spark, path: str) -> str:
    parts = d.split(path, "/")
    return d.filter(d.slice(parts, "1", f"{d.size(parts)} - 1"), "w", "w <> '' AND w <> '.'")


def parent_name(d: Spark, path: str) -> str:
    """The name of the directory that holds a file; empty at the top."""
    parts = d.split(path, "/")
    return f"CASE WHEN {d.size(parts)} > 1 THEN {d.at(parts, '-2')} ELSE '' END"


def path_terms(d: Spark, path: str) -> str:
    """The terms of a path, lower-cased before it is cut into identifiers."""
    words = d.filter(d.split(f"lower({path})", "[^a-z0-9_]+"), "w", "w <> ''")
    return d.distinct(f"flatten({d.map(words, 'w', identifier_parts(d, 'w'))})")


def query_path_terms(d: Spark, text: str) -> str:
    """The terms of a query that may name a path: words of three letters or more that are no stop words, and their parts."""
    words = d.filter(d.split(f"lower(coalesce({text}, ''))", "[^a-z0-9_]+"), "w", f"length(w) >= 3 AND w NOT IN {stop_list()}")
    return d.distinct(f"flatten({d.map(words, 'w', identifier_parts(d, 'w'))})")


def symbol_terms(d: Spark, text: str) -> str:
    """The terms of a query that may name a symbol: words of two letters or more and their parts, in order."""
    words = d.filter(d.split(f"coalesce({text}, '')", "[^A-Za-z0-9_$]+"), "w", "length(w) >= 2")
    return d.distinct(d.filter(f"flatten({d.map(words, 'w', identifier_parts(d, 'w'))})", "p", "length(p) >= 2"))


def trimmed(d: Spark, text: str) -> str:
    return d.replace_all(f"coalesce({text}, '')", "^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def indexed_pieces(d: Spark) -> str:
    """The texts a chunk is indexed by, each tokenised on its own: content, symbols, breadcrumbs, file stem and directories."""
    symbols = f"flatten({d.map('symbols', 's', d.array('s.name', 's.name', 's.kind'))})"
    dirs = directories(d, "file_path")
    near = d.slice(dirs, f"greatest({d.size(dirs)} - 2, 1)", d.size(dirs))
    name = stem(d, "file_path")
    return d.cat(d.array("coalesce(content, '')"), f"coalesce({symbols}, {d.no_strings()})", f"coalesce(breadcrumbs, {d.no_strings()})", d.array(name, name), near)


def semantic_text(d: Spark) -> str:
    """What a chunk is embedded by."""
    names = d.join(d.map("symbols", "s", "s.name"), " ")
    crumbs = d.join("breadcrumbs", " > ")
    parts = ["'path: '", "file_path", d.lit("\nlanguage: "), "coalesce(language, 'unknown')", d.lit("\nsymbols: "), f"coalesce({names}, '')", d.lit("\ncontext: "), f"coalesce({crumbs}, '')", d.lit("\n\n"), "coalesce(content, '')"]
    return f"concat({', '.join(parts)})"


def normalized_path(d: Spark, path: str) -> str:
    """A filter path with forward slashes and without empty or ``.`` segments."""
    return d.join(d.filter(d.split(f"replace({path}, {d.lit(chr(92))}, '/')", "/"), "w", "w <> '' AND w <> '.'"), "/")


def word_count(d: Spark, text: str) -> str:
    """White-space separated words, at least one."""
    return f"greatest(1, {d.size(d.filter(d.split(f"coalesce({text}, '')", '[ \t\n\r\f]+'), 'w', "w <> ''"))})"

"""Predicates over query texts and paths, as SQL expressions for either dialect."""

from __future__ import annotations

from quern.functions.dialect import Spark
from quern.functions.text import query_path_terms, trimmed

# Patterns and phrases of the query classes.
SYMBOL = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
EMBEDDED = r"(?:^|[^A-Za-z0-9_])(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)(?:$|[^A-Za-z0-9_])"
MEMBER = r"(?:^|[^A-Za-z0-9_])[a-z_][A-Za-z0-9_]*(?:\.[a-z_][A-Za-z0-9_]*)+(?:$|[^A-Za-z0-9_])"
QUESTION = r"\?$|^(?:how|what|where|when|why|which|who) "
TOPIC = r" (?:architecture|design|flow|lifecycle|pipeline)"
ARCHITECTURE = TOPIC + r"|^how (?:does|are) "
FILE_CARD = r" (?:architecture|design|flow|lifecycle|pipeline|module|subsystem|package|layer|entry point|where )|^where "
STEM_WORDS = r"public|api|config|schema|builder|worker|reporter|snapshot|state|task|type|error|parser|serializer|implementation|router|request|response"
PATH_PHRASES = r"public api|test file|test block|source file|example|docs|documentation"
TESTS_WANTED, DOCS_WANTED = r"test|spec|fixture|mock", r"doc|readme|example|guide"
TYPES_WANTED = r" type| interface| public api| api | api$|declaration"
# Names of test files: how the name begins, how it ends, and in which languages' files.
TEST_NAMES = (
    ("test_", "", "py cpp c dart lua"), ("", "_test", "py go rb cpp c dart lua"), ("", "Test", "java kt swift cs php scala"), ("", "Tests", "java kt swift cs"), ("", "_spec", "rb lua"),
    ("", ".test", "js jsx ts tsx"), ("", ".spec", "js jsx ts tsx"), ("", "Spec", "kt swift scala"), ("", "Suite", "scala"), ("test_helper", "", "*"),
)
TEST_FILE = "(?:^|/)(?:" + "|".join(f"{b}[^/]*{e.replace('.', '[.]')}[.](?:{x.replace(' ', '|') if x != '*' else '[A-Za-z0-9_]+'})" for b, e, x in TEST_NAMES) + ")$"
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLES_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
TYPE_DEFS = r"\.d\.ts$"
PUBLIC_STEMS = "('api', 'public', 'index', 'mod', 'lib')"
PUBLIC_WORDS = ("api", "public", "function", "functions", "builder", "builders", "schema", "schemas", "type", "types", "enum", "enums")


def query_features(d: Spark, text: str) -> dict[str, str]:
    """The classes of a query text by name."""
    trim = trimmed(d, text)
    low, low_trim = f"lower(coalesce({text}, ''))", f"lower({trim})"
    words = d.split(f"coalesce({text}, '')", "[ \t\n\r\f]+")
    bare = d.map(words, "w", d.replace_all("w", "^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))
    symbol = d.match(trim, SYMBOL)
    question, topic = d.match(low_trim, QUESTION), d.match(low_trim, TOPIC)
    mixed = f"({d.match(f"coalesce({text}, '')", EMBEDDED)} OR {d.size(d.filter(bare, 'w', d.match('w', SYMBOL)))} > 0)"
    camel = d.match(f"coalesce({text}, '')", "[a-z][A-Z]")
    camel_word = f"({d.size(d.filter(bare, 'w', f'length(w) >= 3 AND {d.match("w", "[a-z][A-Z]")}'))} > 0)"
    return {
        "is_symbol": symbol,
        "is_architecture": d.match(low_trim, ARCHITECTURE),
        "is_question": question,
        "is_mixed": mixed,
        "may_embed_symbol": f"({camel} OR {d.match(f"coalesce({text}, '')", MEMBER)})",
        "stem_boost": d.match(low, STEM_WORDS),
        "path_intent": f"({d.size(query_path_terms(d, text))} > 0 OR {d.match(low, PATH_PHRASES)})",
        "has_camel_word": camel_word,
        "is_broad": f"({question} OR {topic})",
        "is_file_card": d.match(low_trim, FILE_CARD),
        "allow_tests": d.match(low, TESTS_WANTED),
        "allow_examples": d.match(low, DOCS_WANTED),
        "allow_type_defs": d.match(low, TYPES_WANTED),
        "wants_test_file": d.match(low, "test file|test block|describe"),
        "wants_docs": d.match(low, "docs|documentation"),
        "wants_examples": f"contains({low}, 'example')",
        "wants_public_api": f"contains({low}, 'public api')",
        "wants_source_file": f"contains({low}, 'source file')",
        "category": f"CASE WHEN NOT contains({trim}, ' ') THEN 'symbol' WHEN {d.starts(low_trim, "'how '")} THEN 'architecture' ELSE 'semantic' END",
    }


def resolved_alpha(alpha: str) -> str:
    """The query's own alpha, else the one of its class; over the columns of ``query_features``."""
    own = f"CASE WHEN isnan({alpha}) THEN NULL ELSE {alpha} END"
    return f"coalesce({own}, CASE WHEN is_symbol THEN 0.25 WHEN is_architecture OR is_question THEN 0.65 WHEN is_mixed THEN 0.45 ELSE 0.55 END)"


def pool_size(top_k: str) -> str:
    """Candidates of each retriever for a hybrid query."""
    k = f"greatest(coalesce({top_k}, 5), 1)"
    return f"CASE WHEN is_symbol THEN greatest({k} * 12, 120) WHEN is_broad THEN greatest({k} * 50, 500) ELSE greatest({k} * 20, 200) END"


def path_flags(d: Spark, path: str) -> dict[str, str]:
    """The classes of a path by name; a backslash counts as a slash."""
    p = f"replace({path}, {d.lit(chr(92))}, '/')"
    name = d.at(d.split(p, "/"), "-1")
    return {
        "is_test": f"({d.match(p, TEST_FILE)} OR {d.match(p, TEST_DIR)})",
        "is_stub": f"({name} IN ('__init__.py', 'package-info.java'))",
        "is_compat": d.match(p, COMPAT_DIR),
        "is_example": d.match(p, EXAMPLES_DIR),
        "is_type_def": d.match(p, TYPE_DEFS),
        "is_test_lower": f"({d.match(f'lower({p})', TEST_FILE)} OR {d.match(f'lower({p})', TEST_DIR)})",
        "is_test_file_lower": d.match(f"lower({p})", TEST_FILE),
        "is_example_lower": d.match(f"lower({p})", EXAMPLES_DIR),
    }

"""Where top-level blocks of source text begin, by a light scan of strings, comments and line starts."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Languages by the last part of a file name.
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "rb": "ruby", "sql": "sql", "md": "markdown", "markdown": "markdown",
    "sh": "bash", "bash": "bash", "zsh": "bash", "json": "json",
}

_LINE_COMMENT = r"//[^\n]*"
_BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\[\s\S]|[^"\\\n])*"?'
_SINGLE = r"'(?:\\[\s\S]|[^'\\\n])*'?"
_TEMPLATE = r"`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"
_RAW_TICK = r"`[^`]*(?:`|\Z)"
_HASH = r"(?<![\w$\"'}&])#[^\n]*"

#: What may hide a line start, by language; comments are the first group.
_TOKENS = {
    "python": rf"({_HASH})|[rbuf]{{0,2}}(?:\"\"\"(?:\\[\s\S]|[\s\S])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[\s\S])*?(?:'''|\Z))|{_DOUBLE}|{_SINGLE}",
    "javascript": rf"({_LINE_COMMENT}|{_BLOCK_COMMENT})|{_DOUBLE}|{_SINGLE}|{_TEMPLATE}",
    "go": rf"({_LINE_COMMENT}|{_BLOCK_COMMENT})|{_DOUBLE}|'(?:\\.|[^'\\\n])+'|{_RAW_TICK}",
    "java": rf"({_LINE_COMMENT}|{_BLOCK_COMMENT})|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_DOUBLE}|'(?:\\.|[^'\\\n])+'",
    "rust": rf"({_LINE_COMMENT}|{_BLOCK_COMMENT})|b?r(#*)\"[\s\S]*?(?:\"\2|\Z)|\"(?:\\[\s\S]|[^\"\\])*(?:\"|\Z)|'(?:\\.[^'\n]*|[^'\\\n])'",
    "c": rf"({_LINE_COMMENT}|{_BLOCK_COMMENT})|{_DOUBLE}|'(?:\\.|[^'\\\n])+'",
    "ruby": rf"(^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z)|{_HASH})|<<[~-]?(['\"]?)([A-Z_]\w*)\2[^\n]*\n[\s\S]*?(?:^[ \t]*\3[ \t]*$|\Z)|{_DOUBLE}|{_SINGLE}",
    "bash": rf"((?<![\w$\"'}}&{{\\])#[^\n]*)|<<-?[ \t]*(['\"]?)(\w+)\2[^\n]*\n[\s\S]*?(?:^[ \t]*\3[ \t]*$|\Z)|\"(?:\\[\s\S]|[^\"\\])*(?:\"|\Z)|'[^']*(?:'|\Z)",
    "sql": rf"(--[^\n]*|{_BLOCK_COMMENT})|\$(\w*)\$[\s\S]*?(?:\$\2\$|\Z)|'(?:''|[^'])*(?:'|\Z)",
}
_TOKENS["typescript"] = _TOKENS["javascript"]

_JS_DECLARATION = (
    r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b|class\b|interface\s+\w|type\s+\w|enum\s+\w|namespace\s+\w|module\s+[\w'\"]|const\b|let\b|var\b)"
    r"|export\s+(?:default\b|=)|(?:module\.)?exports(?:\.\w+|\[[^\]]+\])*\s*=|[A-Z]\w*\.prototype\.\w+\s*="
)
#: ``(imports, declarations, lines that belong to what follows)``, matched where a line begins.
_LINES = {
    "python": (r"(?:import|from)\s+[\w.]", r"(?:async\s+def|def|class)\s+\w|type\s+\w+\s*(?:\[[^\]]*\]\s*)?=|[A-Za-z_]\w*\s*(?::\s*[^=\n]+)?=(?!=)|[A-Za-z_]\w*\s*:\s*[A-Za-z_][\w.\[\], |]*$", r"@\w|#"),
    "javascript": (r"import\b(?!\s*\()|(?:const|let|var)\s+[\w{][^=\n]*=\s*require\(|['\"]use strict['\"]", _JS_DECLARATION, r"@\w|//|/\*"),
    "go": (r"import\b|package\s+\w", r"(?:func|type|var|const)\b", r"//|/\*"),
    "java": (r"(?:import|package)\s+[\w.]", r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|default)\s+)*(?:class|interface|enum|record|@interface)\s+\w|(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ?.]+[\s>]\w+\s*[(=;]", r"@(?!interface\b)\w|//|/\*"),
    "rust": (r"(?:pub(?:\([^)]*\))?\s+)?(?:use\s|extern\s+crate\b)", r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*(?:fn|struct|enum|trait|impl|type|mod|union|static|const)\b|macro_rules!|extern\s+\"", r"#!?\[|//|/\*"),
    "c": (r"#\s*include\b|using\s", r"#\s*define\b|(?:struct|enum|union|typedef|static|extern|const|inline|namespace|template|class)\b|(?!(?:if|for|while|switch|return|else|do|goto|case|default|break|continue|sizeof)\b)[A-Za-z_][\w:<>,]*(?:\s+|\s*\*+\s*)(?:[\w:<>]+[\s*]+)*[\w:~]+\s*(?:\(|=|;|\[)", r"//|/\*|\[\[|__attribute__"),
    "ruby": (r"(?:require|require_relative|load|autoload)\b", r"(?:(?:private|protected|public|module_function)\s+)?(?:class|module|def)\s|[A-Za-z_]\w*(?:::\w+)*\s*(?:\|\|)?=(?![=~>])|\$\w+\s*=", r"#|=begin"),
    "bash": (r"(?:source|\.)\s+\S", r"(?:function\s+[\w:.-]+|[\w:.-]+\s*\(\s*\))|(?:(?:export|readonly|declare|typeset|local)\s+(?:-\w+\s+)*)?[A-Za-z_]\w*\+?=", r"#(?!!)"),
    "sql": (r"(?!)", r"(?i:select|insert|update|delete|create|alter|drop|with|merge|grant|revoke|truncate|begin|commit|rollback|set|explain|copy|analyze|vacuum|call|use|declare|replace|comment|refresh|do)\b", r"--|/\*"),
}
_LINES["typescript"] = _LINES["javascript"]
_PACKAGE = re.compile(r"package\s")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n`]*)")

_SCAN = {k: re.compile(v, re.MULTILINE) for k, v in _TOKENS.items()}
_STARTS = {k: tuple(re.compile(x) for x in v) for k, v in _LINES.items()}

#: A longer line was not written as lines; nothing begins there.
PACKED_LINE = 1000


def language_of(language: str | None, file_path: str | None) -> str | None:
    """The language, whatever its case; of a null or unknown one what the file's name says."""
    known = (language or "").strip().lower()
    if known in _TOKENS or known in ("markdown", "json"):
        return known
    return EXTENSIONS.get((file_path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower())


def _opening(text: str, language: str) -> int:
    """The end of a string or comment that was opened before the text began; 0 if there is none."""

    def line_at(at: int) -> str:
        begin = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        return text[begin : end if end >= 0 else len(text)].strip()

    if language in ("javascript", "typescript", "go", "java", "rust", "c", "sql"):
        close, opens = text.find("*/"), text.find("/*")
        if close >= 0 and (opens < 0 or close < opens) and line_at(close).startswith("*"):
            return close + 2
    if language in ("javascript", "typescript", "go"):
        for m in _SCAN[language].finditer(text):
            if m.group()[0] == "`":
                if re.match(r"`\s*[;,)\].+}]*\s*$", line_at(m.start())) and line_at(m.start())[0] == "`" and not text[: m.start()].rstrip().endswith(("=", "(", ",", "+", "return")):
                    return m.start() + 1
                break
    if language == "python":
        at = min((x for x in (text.find('"""'), text.find("'''")) if x >= 0), default=-1)
        if at >= 0:
            line, before = line_at(at), text[:at].rstrip()
            if (line in ('"""', "'''") and not before.endswith((":", "=", "(", ","))) or (line.endswith(('"""', "'''")) and not line.startswith(('"""', "'''")) and line.count(text[at : at + 3]) == 1 and "=" not in line and "(" not in line):
                return at + 3
    if language == "rust":
        close = text.find('"#')
        opens = re.search(r'r#+"', text)
        if close >= 0 and (not opens or close < opens.start()) and line_at(close).startswith('"#'):
            return close + 2
    return 0


def _markdown(lines: list[str]) -> list[int]:
    fences = [(i, m[1][0], len(m[1]), bool(m[2].strip())) for i, x in enumerate(lines) if (m := _FENCE.match(x))]

    def headings(inside: bool) -> tuple[int, list[int]]:
        found, wrong, mark = [], 0, ("`", 3) if inside else None
        at = {i: (c, n, info) for i, c, n, info in fences}
        for i, x in enumerate(lines):
            if i in at:
                c, n, info = at[i]
                if mark is None:
                    mark = (c, n)
                elif info:
                    wrong += 1
                elif c == mark[0] and n >= mark[1]:
                    mark = None
            elif mark is None and _HEADING.match(x) and i and not lines[i - 1].strip():
                found.append(i)
        return wrong, found

    outside = headings(False)
    # A chunk that opens within fenced code shows by a fence with a language where one should close.
    return min(outside, headings(True), key=lambda h: h[0])[1] if outside[0] else outside[1]


def block_starts(content: str, language: str | None) -> list[int]:
    """The numbers (from 0) of the lines at which a top-level block starts, but for the first line that is not blank.

    A block starts after a blank line.  Lines inside strings, comments, fenced code and bodies start none; comment,
    decorator and attribute lines right above a declaration start its block.  Unknown languages, JSON and packed lines
    have none.
    """
    text = content.replace("\r\n", "\n")
    lines = text.split("\n")
    first = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    if language == "markdown":
        return [i for i in _markdown(lines) if i > first]
    if language not in _SCAN:
        return []
    # 0: code, 1: within a comment, 2: within a string, by what the line begins in.
    kinds = bytearray(len(lines))
    edges = [0]
    for x in lines:
        edges.append(edges[-1] + len(x) + 1)
    begin = _opening(text, language)
    if begin:
        for i in range(1 + bisect_right(edges, begin) - 1):
            kinds[i] = 2
    for m in _SCAN[language].finditer(text, begin):
        if "\n" in m.group():
            a, b = bisect_right(edges, m.start()) - 1, bisect_right(edges, m.end() - 1) - 1
            kind = 1 if m.group(1) is not None else 2
            for i in range(a + 1, b + 1):
                kinds[i] = kind
    blank = [not x.strip() and not kinds[i] for i, x in enumerate(lines)]
    imports, declares, heads = _STARTS[language]
    found: list[int] = []
    package_only = statement = False
    i = 0
    while i < len(lines):
        x = lines[i]
        if language == "sql" and not kinds[i] and not blank[i] and statement:
            statement = not re.sub(r"--[^\n]*", "", x).rstrip().endswith(";")
            i += 1
            continue
        if blank[i] or kinds[i] or x[:1].isspace() or (i and not blank[i - 1]):
            if language == "sql" and not kinds[i] and not blank[i] and not x[:1].isspace() and declares.match(x):
                statement = not re.sub(r"--[^\n]*", "", x).rstrip().endswith(";")
            i += 1
            continue
        at = i
        # Lines that belong to what follows them, up to the first that does not.
        while at < len(lines) and not blank[at] and (kinds[at] == 1 or (not kinds[at] and heads.match(lines[at].lstrip()))):
            decorator = not kinds[at] and lines[at][:1] in "@#[" and not lines[at].startswith("# ")
            at += 1
            while decorator and at < len(lines) and not blank[at] and (lines[at][:1].isspace() or lines[at][:1] == ")"):
                at += 1
        starts = False
        if at >= len(lines):
            starts = at > i  # cut off within the lines above a declaration
        elif not blank[at] and not kinds[at] and len(lines[at]) <= PACKED_LINE:
            y = lines[at]
            if imports.match(y):
                starts = not (package_only and not _PACKAGE.match(y))
                package_only = bool(_PACKAGE.match(y)) and (at + 1 >= len(lines) or blank[at + 1])
            elif declares.match(y):
                starts, package_only = True, False
                if language == "sql":
                    statement = not re.sub(r"--[^\n]*", "", y).rstrip().endswith(";")
        if starts and i > first:
            found.append(i)
        i = max(at, i) + 1
    return found

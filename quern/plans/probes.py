"""Batches of queries made from the chunks' own symbols: names to be found, asked for in every form the engine knows.

They take the place of the logged queries (``asked_queries``), so whatever follows runs as it does for those.
"""

from __future__ import annotations

from quern.functions.dialect import Spark

#: The most widespread symbols are asked for.
NAMES = 40
#: Query ids are the name's place times this, plus the form; with several alphas times their number, plus the alpha's place.
STRIDE = 16
PLAIN, DEFINED = 0, 5
#: Alphas to be compared; null is the engine's own choice.
ALPHAS = ("NULL", "0.25", "0.45", "0.65", "0.85")


def _forms(d: Spark, n: str) -> list[str]:
    """A name alone, as a member in four notations, and in questions."""
    return [n, f"concat('core::', {n})", f"concat('obj->', {n})", f"concat('obj.', {n})", f"concat({d.lit('ns' + chr(92))}, {n})", f"concat('where is ', {n}, ' defined?')", f"concat('the ', {n}, ' attribute')", f"concat('how does ', {n}, ' call client.', {n})", n, n]


def _numbers(count: int, name: str) -> str:
    return f"(VALUES {', '.join(f'({i})' for i in range(count))}) f({name})"


def symbol_questions(d: Spark) -> str:
    """Every form of every name; the last two with languages and with paths as filters, some of which match nothing."""
    forms = _forms(d, "p.name")
    texts = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(forms))
    languages, paths = len(forms) - 2, len(forms) - 1
    return f"""SELECT CAST((p.place - 1) * {STRIDE} + f.form AS BIGINT) AS query_id, CASE f.form {texts} END AS query_text, 'hybrid' AS search_mode, 20 AS top_k, CAST(NULL AS DOUBLE) AS alpha,
      CASE WHEN f.form = {languages} THEN {d.array("'python'", "'go'", "'cobol'")} ELSE {d.null_strings()} END AS filter_languages,
      CASE WHEN f.form = {paths} THEN {d.array("concat('./', p.path)", "'no/such/file.py'")} ELSE {d.null_strings()} END AS filter_paths, CAST(NULL AS TIMESTAMP) AS issued_at
    FROM probe_names p JOIN {_numbers(len(forms), "form")} ON f.form >= 0"""


def alpha_questions(d: Spark) -> str:
    """Two forms of every name, once per alpha."""
    forms = _forms(d, "p.name")
    alphas = " ".join(f"WHEN {i} THEN CAST({a} AS DOUBLE)" for i, a in enumerate(ALPHAS))
    n = len(ALPHAS)
    return f"""SELECT CAST(((p.place - 1) * {STRIDE} + CASE WHEN f.k < {n} THEN {PLAIN} ELSE {DEFINED} END) * {n} + f.k % {n} AS BIGINT) AS query_id, CASE WHEN f.k < {n} THEN {forms[PLAIN]} ELSE {forms[DEFINED]} END AS query_text,
      'hybrid' AS search_mode, 10 AS top_k, CASE f.k % {n} {alphas} END AS alpha, {d.null_strings()} AS filter_languages, {d.null_strings()} AS filter_paths, CAST(NULL AS TIMESTAMP) AS issued_at
    FROM probe_names p JOIN {_numbers(2 * n, "k")} ON f.k >= 0"""

"""Two SQL dialects behind one set of names: Spark's, which the engine runs on, and DuckDB's, in which results are checked."""

from __future__ import annotations


#: Stands for the greatest pool of a batch of queries until the batch is known.
GREATEST_POOL = "{greatest_pool}"


class Spark:
    """Spark SQL text."""

    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def no_strings(self) -> str:
        return "cast(array() as array<string>)"

    def string(self) -> str:
        return "STRING"

    def no_numbers(self) -> str:
        return "cast(array() as array<bigint>)"

    def null_strings(self) -> str:
        return "cast(null as array<string>)"

    def map(self, a: str, x: str, body: str) -> str:
        return f"transform({a}, {x} -> {body})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"filter({a}, {x} -> {body})"

    def cat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def at(self, a: str, i: str) -> str:
        return f"element_at({a}, {i})"

    def slice(self, a: str, first: str, last: str) -> str:
        return f"slice({a}, cast(({first}) as int), cast(greatest(({last}) - ({first}) + 1, 0) as int))"

    def join(self, a: str, between: str) -> str:
        return f"array_join({a}, {self.lit(between)})"

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.lit(pattern)})"

    def all_matches(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def match(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.lit(pattern)})"

    def match_text(self, s: str, pattern: str) -> str:
        """The same with a pattern that is an expression."""
        return f"({s} RLIKE {pattern})"

    def quoted(self, s: str) -> str:
        """An expression's text as a literal part of a pattern."""
        return f"concat('\\\\Q', {s}, '\\\\E')"

    def extract(self, s: str, pattern: str, group: int) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def replace_all(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by.replace('\\', '$'))})"

    def starts(self, s: str, prefix: str) -> str:
        return f"startswith({s}, {prefix})"

    def ends(self, s: str, suffix: str) -> str:
        return f"endswith({s}, {suffix})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def unnest(self, a: str, alias: str, column: str) -> str:
        return f" LATERAL VIEW explode({a}) {alias} AS {column}"

    def unnest_at(self, a: str, alias: str, place: str, column: str) -> str:
        """With the place from 1."""
        return f" LATERAL VIEW posexplode({a}) {alias}_0 AS {place}_0, {column} LATERAL VIEW explode(array(cast({place}_0 + 1 as bigint))) {alias} AS {place}"

    def hex_number(self, s: str) -> str:
        return f"cast(conv({s}, 16, 10) as bigint)"

    def ordered_list(self, x: str, by: str) -> str:
        return f"transform(array_sort(collect_list(struct({by} AS k, {x} AS x))), s -> s.x)"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def within(self, rank: str, pool: str) -> str:
        """``rank`` up to the column ``pool``; the greatest pool of the batch is a literal, so that tasks keep no more rows."""
        return f"{rank} <= {GREATEST_POOL} AND {rank} <= {pool}"

    def settled(self, column: str, expression: str, alias: str) -> str:
        """A column that is computed once, whatever reads it."""
        return f" LATERAL VIEW explode(array({expression})) {alias} AS {column}"

    def bytes(self, s: str) -> str:
        return f"cast(octet_length({s}) as bigint)"

    def range(self, first: str, last: str) -> str:
        return f"sequence({first}, {last})"

    def replace_camel(self, s: str) -> str:
        return f"transform(split({s}, {self.lit('(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])')}), y -> lower(y))"


class Duck(Spark):
    """DuckDB SQL text."""

    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def no_strings(self) -> str:
        return "CAST([] AS VARCHAR[])"

    def string(self) -> str:
        return "VARCHAR"

    def no_numbers(self) -> str:
        return "CAST([] AS BIGINT[])"

    def null_strings(self) -> str:
        return "CAST(NULL AS VARCHAR[])"

    def map(self, a: str, x: str, body: str) -> str:
        return f"list_transform({a}, lambda {x}: {body})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"list_filter({a}, lambda {x}: {body})"

    def cat(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def at(self, a: str, i: str) -> str:
        return f"list_extract({a}, {i})"

    def slice(self, a: str, first: str, last: str) -> str:
        return f"list_slice({a}, {first}, {last})"

    def join(self, a: str, between: str) -> str:
        return f"array_to_string({a}, {self.lit(between)})"

    def split(self, s: str, pattern: str) -> str:
        return f"string_split_regex({s}, {self.lit(pattern)})"

    def all_matches(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)})"

    def match(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def match_text(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {pattern})"

    def quoted(self, s: str) -> str:
        return f"regexp_escape({s})"

    def replace_all(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def starts(self, s: str, prefix: str) -> str:
        return f"starts_with({s}, {prefix})"

    def ends(self, s: str, suffix: str) -> str:
        return f"ends_with({s}, {suffix})"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def unnest(self, a: str, alias: str, column: str) -> str:
        return f" CROSS JOIN LATERAL (SELECT unnest({a}) AS {column}) {alias}"

    def unnest_at(self, a: str, alias: str, place: str, column: str) -> str:
        return f" CROSS JOIN LATERAL (SELECT unnest({a}) AS {column}, generate_subscripts({a}, 1) AS {place}) {alias}"

    def hex_number(self, s: str) -> str:
        return f"CAST(('0x' || {s}) AS BIGINT)"

    def ordered_list(self, x: str, by: str) -> str:
        return f"list({x} ORDER BY {by})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def within(self, rank: str, pool: str) -> str:
        return f"{rank} <= {pool}"

    def settled(self, column: str, expression: str, alias: str) -> str:
        return f" CROSS JOIN LATERAL (SELECT {expression} AS {column}) {alias}"

    def bytes(self, s: str) -> str:
        return f"CAST(strlen({s}) AS BIGINT)"

    def range(self, first: str, last: str) -> str:
        return f"generate_series({first}, {last})"

    def replace_camel(self, s: str) -> str:
        for pattern in ("([a-z])([A-Z0-9])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
            s = f"regexp_replace({s}, '{pattern}', '\\1 \\2', 'g')"
        return f"string_split(lower({s}), ' ')"


SPARK, DUCK = Spark(), Duck()

"""Rewrite rules as data: one list gives a Spark expression and its SQL.

A rule is (pattern, replacement) in the syntax that Java and RE2 share, with
``\\1`` for groups.  Rules are applied once each, in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]

#: Case-insensitive and Unicode-aware, as Java spells it.
JAVA_FLAGS = "(?iuU)"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rewrite(c: Column, rules: Iterable[Rule]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, F.lit(JAVA_FLAGS + r[0]), F.lit(re.sub(r"\\(\d)", r"$\1", r[1]))), rules, c)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` reads it."""
    return F.transform(F.array(c), f)[0]


def without_tails(c: Column, words: Sequence[str], lead: str) -> Column:
    """Strip words from the end of a lower-case text, each tried once, in order.

    One pass instead of one for each word: what the words strip in turn is the
    run of optional words, the last one first, that reaches the end.  No word
    may be the end of another one, as such a run would then be read in two ways.
    """
    tail = "".join(rf"(?:{lead}(?:{w})\s*)?" for w in reversed(words))
    return F.regexp_replace(c, F.lit(f"(?U){tail}$"), F.lit(""))


def rewrite_sql(c: str, rules: Iterable[Rule]) -> str:
    return reduce(lambda x, r: f"regexp_replace({x}, {quote('(?i)' + r[0])}, {quote(r[1])}, 'g')", rules, c)


def matches(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found: one alternation, compiled once."""
    return c.rlike(JAVA_FLAGS + "|".join(f"(?:{p})" for p in patterns))


def matches_sql(c: str, patterns: Sequence[str]) -> str:
    return f"regexp_matches({c}, {quote('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def contains_any_sql(c: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(w)})" for w in words) + ")"


def first_match(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Value of the first rule whose pattern is found, else null."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(c.rlike(JAVA_FLAGS + pattern), F.lit(value)).otherwise(out)
    return out


def first_match_sql(c: str, rules: Sequence[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {quote('(?i)' + p)}) THEN {quote(v)}" for p, v in rules) + " END"


def lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    """A small fixed map as a literal, so no join is planned."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), default)


def lookup_sql(c: str, table: dict[str, str], default: str) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END"

"""Quality rules: a threshold table compiled into one projection.

``RULES`` is the table: a measure, the side of the limit on which a text fails
and the limit.  ``measured`` adds the measures and ``passes`` compiles the
table into one boolean column.  Both are built-in expressions only, so the
operator is a narrow projection over the scan, without a shuffle.

Defined results: a null text counts as empty; an empty text has no words and
fails the base rule; repeated rows are judged alike; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is was for on with as by at from that this are it be or "
    "der die das und zu den mit von ist im nicht ein eine auf für des sich dem "
    "le la les de et un une est en du que dans pour par pas sur plus "
    "el los las del y con una se su al lo"
).split()

#: (measure, side, limit): a text fails below a "min" or above a "max".
RULES = (
    ("symbol_ratio", "max", 0.10),
    ("mean_word_length", "min", 1.5),
    ("mean_word_length", "max", 20.0),
    ("stop_word_ratio", "min", 0.01),
    ("dup_line_ratio", "max", 0.60),
)

BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def _without(c: Column, chars: str) -> Column:
    return reduce(lambda a, x: F.replace(a, F.lit(x), F.lit("")), chars, c)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, counts and ratios of each row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+", -1)).otherwise(F.array().cast("array<string>"))
    d = d.select("*", words.alias("words"))
    # three-word windows as (hash, first word), sorted, so that repeats stand together
    windows = F.expr(
        "if(size(words) < 3, array(), array_sort(transform(sequence(0, greatest(size(words) - 3, 0)), "
        "i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'i', i))))"
    )
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    d = d.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.expr(f"cast(size(filter(words, w -> w in ({stops}))) as long)").alias("n_stop_words"),
        windows.alias("windows"),
        F.expr("filter(split(text, '\\n', -1), x -> length(btrim(x, ' \\t\\n\\u000b\\f\\r')) > 0)").alias("lines"),
    )
    repeated = F.expr(
        "array_sort(transform(filter(windows, (w, k) -> (k > 0 and windows[k - 1].h = w.h) "
        "or (k < size(windows) - 1 and windows[k + 1].h = w.h)), w -> w.i))"
    )
    # words covered by the windows [i, i + 3), each counted once
    covered = F.expr(
        "aggregate(repeated, named_struct('n', 0L, 'e', 0), "
        "(a, i) -> named_struct('n', a.n + i + 3 - greatest(a.e, i), 'e', i + 3), a -> a.n)"
    )
    d = d.select("*", repeated.alias("repeated")).select(
        "doc_id",
        "text",
        "n_words",
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
    )
    return d.select(
        "*",
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("word_chars", "n_words").alias("mean_word_length"),
        _ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def passes(rules=RULES) -> Column:
    """The threshold table as one boolean column over ``measured`` rows."""
    ok = [F.col(m) <= F.lit(x) if side == "max" else F.col(m) >= F.lit(x) for m, side, x in rules]
    return reduce(lambda a, b: a & b, ok, F.lit(True))


def judged(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = measured(docs, id_col, text_col)
    return d.select("*", base_failed().alias("base_failed"), (~base_failed() & passes(rules)).alias("kept"))


def accepted(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    # the mark keeps the filter above the projection: pushed below, it would
    # hold the whole table of rules inlined, with each array sorted anew for
    # every element
    marked = judged(rows, rules, "row", "text").select("doc_id", "kept", F.monotonically_increasing_id().alias("mark"))
    return marked.where("kept and mark >= 0").select("doc_id.*")


def op8_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", "n_lines",
    )


_STOPS_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM d, unnest(range(1, len(words) - 1)) AS t(i)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w) WHERE n > 1
), c AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, unnest([0, 1, 2]) AS u(k)) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({_STOPS_SQL})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.10 * greatest(word_chars, 1)
         AND word_chars >= 1.5 * greatest(n_words, 1) AND word_chars <= 20 * greatest(n_words, 1)
         AND n_stop_words >= 0.01 * greatest(n_words, 1)
         AND n_dup_lines <= 0.60 * greatest(n_lines, 1) AS kept,
       n_stop_words, n_lines
FROM b
"""

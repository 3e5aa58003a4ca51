"""Tables of phrases and of suffix rules, matched against columns of texts and hosts.

Rules that are few and fixed are compiled into plans (functions.rewrite).
These are for tables of rules, of tens of thousands of rows and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import null_safe_join

#: Bytes of phrases that one automaton, and so one broadcast, may hold.
LIMIT = 16 << 20


def _chunks(phrases: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of ordinals of at most ``limit`` bytes each (or one phrase); counted in the plan."""
    rows = phrases.select("ordinal", F.octet_length("phrase").cast("long").alias("size"))
    total = rows.agg(F.min("ordinal"), F.max("ordinal"), F.sum("size")).first()
    if total[2] is None:
        return []
    ranges, todo = [], [(int(total[0]), int(total[1]) + 1, int(total[2]))]
    while todo:
        low, high, size = todo.pop()
        if size <= limit or high - low == 1:
            ranges.append((low, high))
            continue
        middle = (low + high) // 2
        left = rows.where(F.col("ordinal").between(low, middle - 1)).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        todo += [(low, middle, int(left)), (middle, high, size - int(left))]
    return sorted(ranges)


def _automaton(pairs: list[tuple[str, int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, ordinal in pairs:
        if phrase not in a or a.get(phrase) > ordinal:
            a.add_word(phrase, ordinal)
    if len(a):
        a.make_automaton()
    return a


def _finder(shared):
    """The smallest ordinal of the phrases that a text holds."""

    @F.pandas_udf("long")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton(shared.value)
        for part in parts:
            hits = [min((o for _, o in a.iter(t)), default=None) if t and len(a) else None for t in part]
            yield pd.Series(hits, dtype="Int64")

    return found


def first_phrase(texts: DataFrame, phrases: DataFrame, text_col: str, limit: int = LIMIT) -> DataFrame:
    """J8, F16, F19 by a table: ``ordinal`` and ``value`` of the first phrase that a text holds.

    phrases: ordinal (a key), phrase, value.  All phrases are looked for in one
    pass over a text (Aho-Corasick); of those found the smallest ordinal
    counts.  The automaton is broadcast up to ``limit`` bytes of phrases; a
    larger table is cut into ranges of ordinals, which are tried one after the
    other on the texts that have found nothing yet.

    Matching is exact; lower both sides before if case doesn't count.  A null
    text finds nothing; null and empty phrases are passed over.
    """
    spark = texts.sparkSession
    given = phrases.where("phrase <> '' and ordinal is not null").select(F.col("ordinal").cast("long").alias("ordinal"), "phrase")
    rows = texts.withColumn("__first", F.lit(None).cast("long"))
    for low, high in _chunks(given, limit):
        # at most `limit` bytes, as counted above
        some = given.where(F.col("ordinal").between(low, high - 1)).collect()
        shared = spark.sparkContext.broadcast([(r.phrase, r.ordinal) for r in some])
        del some
        seen = F.when(F.col("__first").isNull(), F.col(text_col))
        rows = rows.withColumn("__hit", _finder(shared)(seen)).withColumn("__first", F.coalesce("__first", "__hit")).drop("__hit")
    values = phrases.select(F.col("ordinal").cast("long").alias("__first"), "value")
    return null_safe_join(rows, values, ["__first"], "left").withColumnRenamed("__first", "ordinal")


def registered_domains(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """L7 by a table of public suffixes: ``registered``, the suffix of a host and one name more.

    rules: rule, as in the public list: ``co.uk``, ``*.ck`` (every name below),
    ``!www.ck`` (but not this one).  The exception prevails, then the longest
    rule; without a rule the last name is the suffix.  Each suffix of each
    different host is looked up, so the table may have any size.  Addresses,
    single names and hosts that are suffixes themselves have no registered
    domain.  Names are compared in lower case, in the script they are written in.
    """
    host = F.rtrim(F.lower(F.col(host_col)), F.lit("."))
    names = hosts.select(F.col(host_col).alias("__host"), F.split(host, r"\.").alias("__names")).distinct()
    names = names.where(F.col("__host").isNotNull() & ~F.col("__host").rlike(r"^[0-9.]*$|:"))
    last = lambda k: F.array_join(F.slice("__names", F.size("__names") - k + 1, k), ".")
    each = names.select("__host", "__names", F.explode(F.sequence(F.lit(1), F.size("__names"))).alias("k")).withColumn("__suffix", last(F.col("k")))
    plain = F.regexp_replace(F.lower("rule"), r"^(!|\*\.)", "")
    kind = F.when(F.startswith("rule", F.lit("!")), 2).when(F.startswith("rule", F.lit("*.")), 1).otherwise(0)
    table = rules.where("rule is not null").select(plain.alias("__suffix"), kind.alias("kind")).distinct()
    hits = each.join(table, "__suffix").select("__host", F.struct((F.col("kind") == 2).alias("but"), F.when(F.col("kind") == 2, F.col("k") - 1).when(F.col("kind") == 1, F.col("k") + 1).otherwise(F.col("k")).alias("size")).alias("hit"))
    best = hits.groupBy("__host").agg(F.max("hit").alias("hit"))
    size = F.coalesce("hit.size", F.lit(1))
    found = names.join(best, "__host", "left").select("__host", F.when(F.size("__names") > size, last(size + 1)).alias("registered"))
    return hosts.join(found, hosts[host_col] == found["__host"], "left").drop("__host")

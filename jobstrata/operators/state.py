"""Keyed state machines as folds, and table upserts.

A domain's spacing (E4) is a fold of functions; they compose, so blocks of a
domain's fetches are folded apart and then together.  Streams use the same
functions, fetch by fetch.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import http_date

BASE_DELAY, MAX_DELAY, MAX_FAILURES = 0.5, 30.0, 3


def retry_after_seconds(value: Column, at: Column | None = None) -> Column:
    """Seconds to wait; zero and what is neither a number nor a date count as absent.

    A date counts from ``at``, the time of the answer; where that is unknown it
    is absent, one that has passed is zero.
    """
    n = F.when(F.trim(value).rlike(r"^\+?\d+$"), F.trim(value).cast("double"))
    if at is not None:
        left = (F.unix_micros(http_date(value)) - F.unix_micros(at)) / 1e6
        n = F.coalesce(n, F.when(left.isNotNull(), F.greatest(F.floor(left).cast("double"), F.lit(0.0))))
    return F.nullif(n, F.lit(0.0))


class Change(NamedTuple):
    """What fetches do to a spacing x: ``value`` if x <= ``upto``, else min(``times`` * x, ``most``).

    Spacings aren't below ``BASE_DELAY``.  Two changes in a row are one again:
    the functions rise, so what the first sends below the second's ``upto`` is
    one stretch from the bottom.
    """

    upto: float
    value: float
    times: float
    most: float

    def of(self, x: float) -> float:
        return self.value if x <= self.upto else min(self.times * x, self.most)


NONE, ALWAYS = -1.0, math.inf
#: One fetch: limited without a wait, and good.  A wait makes the spacing whatever it was: that wait, at most ``MAX_DELAY``.
LIMITED = Change(NONE, 0.0, 2.0, MAX_DELAY)
GOOD = Change(1.1 * BASE_DELAY / 0.9, BASE_DELAY, 0.9, math.inf)


def change(status: int, wait: float | None) -> Change | None:
    """What one fetch does; other fetches do nothing."""
    if status in (429, 503):
        return Change(ALWAYS, min(wait, MAX_DELAY), 1.0, math.inf) if wait else LIMITED
    return GOOD if 200 <= status < 400 else None


def next_delay(delay: float, status: int, wait: float | None) -> float:
    """A domain's spacing after one more fetch."""
    c = change(status, wait)
    return delay if c is None else c.of(delay)


def _struct(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(Change._fields, values, strict=True)])


def _then(f: Column, g: Column) -> Column:
    """The change that does f, then g."""
    after = F.when(f["value"] <= g["upto"], g["value"]).otherwise(F.least(g["times"] * f["value"], g["most"]))
    whole = (f["upto"] == ALWAYS) | (f["most"] <= g["upto"])
    reach = g["upto"] / f["times"]
    wider = (reach > f["upto"]) | (f["most"] <= g["upto"])
    return _struct(
        F.when(whole, ALWAYS).otherwise(F.greatest(f["upto"], reach)), F.when(wider, g["value"]).otherwise(after),
        F.when(whole, 1.0).otherwise(f["times"] * g["times"]), F.when(whole, ALWAYS).otherwise(F.least(g["times"] * f["most"], g["most"])),
    )


#: Ids of a block of fetches; blocks of a block of blocks.
FOLD = 4096


def delays(fetches: DataFrame, width: int = FOLD) -> DataFrame:
    """Each domain's spacing after its fetches (domain, id, status, retry_after,
    and perhaps ``at``, the time of the answer), in order of ``id``, which is a key.

    Only limited (429, 503) and successful (200-399) fetches change it, so the
    others are dropped before the shuffle.  Blocks of ``width`` ids are folded
    to one change each, blocks of blocks likewise, and what is left (one for
    each ``width`` squared ids) at last, so a domain is never one task's work.
    """
    limited = F.col("status").isin(429, 503)
    wait = retry_after_seconds(F.col("retry_after"), F.col("at") if "at" in fetches.columns else None)
    reset = _struct(ALWAYS, F.least(wait, F.lit(MAX_DELAY)), 1.0, ALWAYS)
    does = F.when(limited & wait.isNotNull(), reset).when(limited, _struct(*LIMITED)).otherwise(_struct(*GOOD))
    rows = fetches.where(limited | F.col("status").between(200, 399)).select("domain", F.col("id").alias("at"), does.alias("does"), F.lit(1).cast("long").alias("n"))
    fold = lambda x: F.aggregate(F.array_sort(x), _struct(NONE, 0.0, 1.0, math.inf), lambda f, r: _then(f, r["does"]))
    for _ in range(2):
        block = F.floor(F.col("at") / width)
        rows = rows.groupBy("domain", block.alias("at")).agg(fold(F.collect_list(F.struct("at", "does"))).alias("does"), F.sum("n").alias("n"))
    whole = rows.groupBy("domain").agg(fold(F.collect_list(F.struct("at", "does"))).alias("does"), F.sum("n").alias("n_events"))
    d = F.col("does")
    delay = F.when(d["upto"] >= BASE_DELAY, d["value"]).otherwise(F.least(d["times"] * BASE_DELAY, d["most"]))
    return whole.select("domain", F.round(delay, 6).alias("delay"), "n_events")


def rate_limit_stats(spacing: DataFrame) -> DataFrame:
    """How many domains there are, and how many are slowed down."""
    return spacing.agg(F.count("*").alias("domains"), F.count_if(F.col("delay") > BASE_DELAY).alias("slowed"), F.max("delay").alias("longest"))


def breaker(fetches: DataFrame, key: str = "domain", order: str = "id") -> DataFrame:
    """Failures in a row at the end; a success resets them and
    makes the address active again, whatever came before.  A fetch without a
    status is neither, and changes nothing.

    Failures after the last success are counted in a second aggregate, so no
    key is sorted or held.
    """
    failed = F.col("status") >= 400
    rows = fetches.select(key, order, failed.alias("failed"))
    last = rows.groupBy(key).agg(F.max(F.when(~F.col("failed"), F.col(order))).alias("__last"), F.count_if("failed").alias("n_failed"))
    after = rows.where("failed").join(last.select(key, "__last"), key).where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).groupBy(key).agg(F.count("*").alias("fail_count"))
    out = last.drop("__last").join(after, key, "left").fillna(0, ["fail_count"])
    return out.select(key, "fail_count", (F.col("fail_count") < MAX_FAILURES).alias("is_active"), "n_failed")


def marked(career_urls: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """E1-E3 on the table: ``outcomes`` (id, outcome) of one scan.

    success: counters to 0, active, stamped; failed: one up, stamped, inactive
    from three on; suspicious: that counter one up.  Others stay as they are.
    """
    o = F.col("__o")
    rows = career_urls.join(outcomes.select("id", F.col("outcome").alias("__o")), "id", "left")
    fails = F.when(o == "success", 0).when(o == "failed", F.col("fail_count") + 1).otherwise(F.col("fail_count"))
    sets = {
        "fail_count": fails.cast("int"),
        "suspicious_count": F.when(o == "success", 0).when(o == "suspicious", F.col("suspicious_count") + 1).otherwise(F.col("suspicious_count")).cast("int"),
        "is_active": F.when(o == "success", True).when((o == "failed") & (fails >= MAX_FAILURES), False).otherwise(F.col("is_active")),
        "last_success_at": F.when(o == "success", now).otherwise(F.col("last_success_at")),
        "last_fail_at": F.when(o == "failed", now).otherwise(F.col("last_fail_at")) if "last_fail_at" in career_urls.columns else None,
    }
    return rows.select(*[sets[c].alias(c) if sets.get(c) is not None else F.col(f"`{c}`") for c in career_urls.columns])


def cache_set(cache: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Entries are replaced by key; namespace and model keep their old
    values, hits begin anew."""
    update = {"value": F.col("new.value"), "ttl_seconds": F.col("new.ttl_seconds"), "created_at": now, "tokens_saved": F.col("new.tokens_saved"), "hit_count": F.lit(0)}
    insert = {"created_at": now, "hit_count": F.lit(0)}
    return upserted(cache, fresh, ["key"], update, insert)


def cache_read(cache: DataFrame, probes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, the cache afterwards).  Each probe (key) gets the value
    of a live entry or null; a live entry counts one hit for each probe."""
    live = is_live(F.col("created_at"), F.col("ttl_seconds"), now)
    answers = probes.join(cache.where(live).select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())
    asked = probes.groupBy("key").agg(F.count("*").alias("__n"))
    hits = F.when(live, F.coalesce("__n", F.lit(0))).otherwise(0)
    after = cache.join(asked, "key", "left").withColumn("hit_count", (F.col("hit_count") + hits).cast(cache.schema["hit_count"].dataType)).select(*cache.columns)
    return answers, after


def worth_caching(value: Column) -> Column:
    """Empty results aren't kept."""
    return F.coalesce(~F.trim(value).isin("", "null", "[]", "{}", '""', "0", "false"), F.lit(False))


def upserted(old: DataFrame, new: DataFrame, by: list[str], update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """Insert or update by key.  ``update`` and ``insert`` see the sides
    as ``old.*`` and ``new.*``; columns not named keep their old value."""
    o, n = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in by]
    both = o.join(n, on, "full_outer")
    was, comes = F.col(f"old.{by[0]}").isNotNull(), F.col(f"new.{by[0]}").isNotNull()
    out = []
    for c in old.columns:
        kept = F.col(f"old.{c}")
        changed = update.get(c, kept)
        fresh = insert.get(c, F.col(f"new.{c}") if c in new.columns else F.lit(None))
        out.append(F.when(was & comes, changed).when(was, kept).otherwise(fresh).alias(c))
    return both.select(*out)


def is_live(created: Column, ttl: Column, now: Column) -> Column:
    """A hit needs to be strictly before its end ..."""
    return created + ttl > now


def is_purged(created: Column, ttl: Column, now: Column) -> Column:
    """... and a purge strictly after it."""
    return created + ttl < now


#: Width of the blocks of time or ids into which a key's rows are cut.
BLOCK = 4096


def _before(column: str, f, key: str) -> Column:
    """``f`` of a column over the earlier blocks of a key."""
    w = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return f(column).over(w)


def most_open(spans: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The most spans (started, ended) of a key that were open at once.

    An end counts before a start at the same time; ends and starts are summed
    by time first.  Each block of time has its own running sum, and the blocks'
    totals are summed up in turn, so a key is never sorted as a whole.
    """
    edges = spans.select(key, F.col("started").alias("t"), F.lit(1).alias("d")).unionByName(spans.select(key, F.col("ended").alias("t"), F.lit(-1).alias("d")))
    summed = edges.groupBy(key, "t", "d").agg(F.sum("d").alias("n")).withColumn("__b", F.floor(F.col("t") / block))
    w = Window.partitionBy(key, "__b").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    blocks = summed.withColumn("open", F.sum("n").over(w)).groupBy(key, "__b").agg(F.max("open").alias("top"), F.sum("n").alias("all"))
    blocks = blocks.select(key, (F.coalesce(_before("all", F.sum, key), F.lit(0)) + F.col("top")).alias("open"))
    return blocks.groupBy(key).agg(F.max("open").alias("most_open"))


def spaced(fetches: DataFrame, block: int = BLOCK) -> DataFrame:
    """E5: when each fetch (domain, id, asked, delay) may start: not before it is
    asked for, nor before the last start of its domain plus its spacing.

    start = max(asked, last + delay) unrolls to the running maximum of
    asked - D over the running sum D of delays, plus D.  Sum and maximum run
    within blocks of ids, and over the blocks' totals, so a domain is never
    sorted as a whole.
    """
    w = Window.partitionBy("domain", "__b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = fetches.withColumn("__b", F.floor(F.col("id") / block)).withColumn("__d", F.sum("delay").over(w))
    rows = rows.withColumn("__m", F.max(F.col("asked").cast("double") - F.col("__d")).over(w)).select("domain", "id", "__b", "__d", "__m")
    blocks = rows.groupBy("domain", "__b").agg(F.max("__d").alias("all"), F.max("__m").alias("top"))
    blocks = blocks.withColumn("__d0", F.coalesce(_before("all", F.sum, "domain"), F.lit(0.0))).withColumn("top", F.col("top") - F.col("__d0"))
    blocks = blocks.select("domain", "__b", "__d0", _before("top", F.max, "domain").alias("__m0"))
    last = F.greatest(F.col("__m") - F.col("__d0"), F.col("__m0"))  # null before the first block, which greatest skips
    return rows.join(blocks, ["domain", "__b"]).select("domain", "id", (last + F.col("__d0") + F.col("__d")).alias("start"))


def touched(rows: DataFrame, ids: DataFrame, key: str, sets: dict[str, Column]) -> DataFrame:
    """Single columns set on the rows that are named, all others kept."""
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(hit, key, "left")
    return out.select(*[F.when(F.col("__hit"), sets[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in rows.columns])

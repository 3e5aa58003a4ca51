"""Keyed state on streams with timers and maps.

These run on ``transformWithState``, which keeps state in RocksDB:
``spark.sql.streaming.stateStore.providerClass`` must name that provider.  The
transitions are those of the batch folds (operators.state).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import BASE_DELAY, MAX_FAILURES, next_delay, retry_after_seconds

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocksdb(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")


def _gathered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


# --- health of domains and addresses -------------------------------------------------

HEALTH = "domain string, url string, fail_count int, is_active boolean, delay double, n_events long"


class CrawlHealth(StatefulProcessor):
    """For each domain its spacing, and for each of its addresses the failures in a row.

    A domain that is quiet for ``idle_ms`` (0: ever) is forgotten, by a timer.
    """

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spacing = handle.getValueState("spacing", "delay double, n_events long")
        self.failures = handle.getMapState("failures", "url string", "fail_count int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _gathered(rows, ["id"])
        held = self.spacing.get() if self.spacing.exists() else (BASE_DELAY, 0)
        delay, n = float(held[0]), int(held[1])
        fails: dict[str, int] = {}
        for url, status, wait in zip(pdf["url"], pdf["status"].to_numpy(np.int32).tolist(), pdf["wait"].to_numpy(np.float64).tolist(), strict=True):
            if url not in fails:
                fails[url] = int(self.failures.getValue((url,))[0]) if self.failures.containsKey((url,)) else 0
            fails[url] = fails[url] + 1 if status >= 400 else 0
            delay = next_delay(delay, status, None if wait != wait else wait)
            n += status in (429, 503) or 200 <= status < 400
        self.spacing.update((delay, n))
        for url, count in fails.items():
            self.failures.updateValue((url,), (count,))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out = list(fails.items())
        yield pd.DataFrame({
            "domain": [key[0]] * len(out), "url": [u for u, _ in out], "fail_count": np.array([c for _, c in out], np.int32),
            "is_active": [c < MAX_FAILURES for _, c in out], "delay": [delay] * len(out), "n_events": [n] * len(out),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spacing.clear()
        self.failures.clear()
        return iter(())

    def close(self) -> None:
        pass


def crawl_health(fetches: DataFrame, idle_ms: int = 0) -> DataFrame:
    """A stream of fetches (domain, url, id, status, retry_after, perhaps ``at``): the
    addresses each micro-batch touched, as they are after it."""
    _needs_rocksdb(fetches.sparkSession)
    wait = retry_after_seconds(F.col("retry_after"), F.col("at") if "at" in fetches.columns else None)
    rows = fetches.where("status is not null").select("domain", F.coalesce("url", F.lit("")).alias("url"), F.col("id").cast("long").alias("id"), F.col("status").cast("int").alias("status"), wait.alias("wait"))
    mode = "ProcessingTime" if idle_ms else "None"
    return rows.groupBy("domain").transformWithStateInPandas(CrawlHealth(idle_ms), HEALTH, "Update", mode)


# --- the response cache ----------------------------------------------------------------

ANSWERS = "key string, seq long, what string, value string, hit_count int, tokens_saved int"


#: Parts that the cache's keys are dealt into; a checkpoint holds to its number.
PARTS = 512


class ResponseCache(StatefulProcessor):
    """Entries, set and read by events; state and timer are those of a part of the keys.

    A read before the entry's end is a hit and is counted; a set begins the
    count anew.  The first set's namespace and model stay, as upserts keep them.
    A timer purges entries once the watermark is past their end.  Each call for
    state is a round trip, so a part's entries are read and written as one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "timer long, key array<string>, value array<string>, end_ms array<long>, hit_count array<int>, tokens_saved array<int>")

    def _held(self) -> tuple[int | None, dict[str, tuple]]:
        got = self.entries.get()
        if got is None:
            return None, {}
        timer, keys, *columns = got
        return timer, dict(zip(keys, zip(*columns, strict=True), strict=True))

    def _keep(self, timer: int | None, held: dict[str, tuple]) -> None:
        due = min((e[1] for e in held.values()), default=None)
        due = None if due is None else due + 1  # purged strictly after its end
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.entries.update((due, list(held), *map(list, zip(*held.values(), strict=True))))
        else:
            self.entries.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _gathered(rows, ["at_ms", "seq"])
        timer, held = self._held()
        changed, out = False, []
        for k, seq, at, op, value, ttl, tokens in zip(*(pdf[c].tolist() for c in ("key", "seq", "at_ms", "op", "value", "ttl_seconds", "tokens_saved")), strict=True):
            e = held.get(k)
            if op == "set":
                held[k] = (value, at + ttl * 1000, 0, tokens)
            elif e is not None and e[1] > at:
                held[k] = e = (e[0], e[1], e[2] + 1, e[3])
                out.append((k, seq, "hit", e[0], e[2], e[3]))
            else:
                out.append((k, seq, "miss", None, 0, 0))
                continue
            changed = True
        if changed:
            self._keep(timer, held)
        yield _answers(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, held = self._held()
        gone = [(k, None, "purged", e[0], e[2], e[3]) for k, e in held.items() if e[1] + 1 < now]
        for k, *_ in gone:
            del held[k]
        self._keep(None, held)  # the timer that went off is gone
        yield _answers(gone)

    def close(self) -> None:
        pass


def _answers(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"key": "object", "seq": "Int64", "what": "object", "value": "object", "hit_count": "int32", "tokens_saved": "int32"}
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def cached_answers(events: DataFrame, late: str = "1 minute", parts: int = PARTS) -> DataFrame:
    """A stream of events (key, seq, at, op 'get' or 'set', value, ttl_seconds,
    tokens_saved) of the cache: an answer for each get, and what was purged.

    Events of a key count in order of (at, seq) within a micro-batch; ``late``
    is how long the watermark waits.  Keys are dealt into ``parts``, so the calls
    for state of a micro-batch are bounded; a part's entries meet in one task.
    """
    _needs_rocksdb(events.sparkSession)
    rows = events.withWatermark("at", late).select(
        F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "at", F.col("seq").cast("long").alias("seq"), F.unix_millis("at").alias("at_ms"), "op", "value",
        F.coalesce("ttl_seconds", F.lit(0)).cast("long").alias("ttl_seconds"), F.coalesce("tokens_saved", F.lit(0)).cast("int").alias("tokens_saved"),
    )
    return rows.groupBy("part").transformWithStateInPandas(ResponseCache(), ANSWERS, "Append", "EventTime")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All a stream gives for what is there now, as a table with the micro-batch of each row."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch:08d}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(path)

"""Crawl health on streams: windows over fetches and keyed state.

Windows and watermarks are an extension; the state machines are those of the
batch folds, run event by event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.reports import outcome
from ..operators.state import BASE_DELAY, MAX_FAILURES, next_delay, retry_after_seconds
from ..operators.postings import null_safe_join
from ..plans.write_path import apply_scan
from ..sources.buckets import BUCKETS, Store
from ..sources.files import SCHEMAS


def health(fetches: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Fetches (domain, status, ts) by window and outcome; works on streams and tables."""
    return (
        fetches.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "domain", outcome(F.col("status")).alias("outcome"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "domain", "outcome", "n")
    )


STATE = "fail_count int, suspicious int, delay double"
RESULT = "domain string, fail_count long, is_active boolean, delay double, n_events long"


def step(fail_count: int, delay: float, status: int, retry_after: float | None) -> tuple[int, float]:
    """One fetch."""
    return (fail_count + 1 if status >= 400 else 0), next_delay(delay, status, retry_after)


def domain_state(fetches: DataFrame) -> DataFrame:
    """E1, E2, E4 on a stream of fetches (domain, id, status, retry_after, perhaps
    ``at``, the time of the answer, from which dates to wait for count).

    Within a micro-batch a domain's fetches count in order of ``id``; only the
    three numbers they depend on are gathered for that.  ``stateful.crawl_health``
    keeps addresses apart and forgets quiet domains, but needs RocksDB.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, _, delay = state.get if state.exists else (0, 0, BASE_DELAY)
        slim = [(p["id"].to_numpy(np.int64), p["status"].to_numpy(np.int32), p["wait"].to_numpy(np.float64)) for p in batches]
        ids, statuses, waits = (np.concatenate(x) for x in zip(*slim, strict=True))
        for k in np.argsort(ids, kind="stable").tolist():
            fails, delay = step(fails, delay, int(statuses[k]), None if np.isnan(waits[k]) else float(waits[k]))
        state.update((fails, 0, delay))
        yield pd.DataFrame({"domain": [key[0]], "fail_count": [fails], "is_active": [fails < MAX_FAILURES], "delay": [delay], "n_events": [len(ids)]})

    wait = retry_after_seconds(F.col("retry_after"), F.col("at") if "at" in fetches.columns else None)
    rows = fetches.where("status is not null").select("domain", "id", "status", wait.alias("wait"))
    return rows.groupBy("domain").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def sessions(fetches: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of fetches of a domain without a longer pause (an extension)."""
    return fetches.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "domain").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "domain", "n")


def moving_health(fetches: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Failures by sliding window (an extension)."""
    window = fetches.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "domain")
    return window.agg(F.count_if(F.col("status") >= 400).alias("n_failed"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "domain", "n_failed", "n")


WAITING = "site_id bigint, suspicious_count int"
HISTORY = "site_id bigint, job_id bigint, event string, details string, changed_at timestamp_ntz"


def catalog_store(spark: SparkSession, root: str, pending: StructType | None = None, buckets: int = BUCKETS) -> Store:
    """The catalog that ``reconcile_each_batch`` keeps: jobs, counts that wait, postings of scans that aren't complete."""
    return Store(spark, root, {"jobs": SCHEMAS["jobs"], "waiting": WAITING, "pending": pending or StructType()}, "site_id", buckets)


def reconcile_each_batch(root: str, now: Callable[[int], Column] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the catalog under ``root``.

    Rows are postings (site_id, scan_id, pos, title, location, and any columns
    of a job) and one row with ``done`` for each scan that is complete, with or
    without postings.  Postings wait until their scan is complete; then the
    guard decides, and what it lets through is reconciled, scan after scan.

    Only the buckets of the batch's sites are read and written; the others stay
    as they are, and all tables change at once with the batch's manifest.  A
    batch that is run again changes nothing; one that broke off left nothing.
    Columns that a batch adds to postings begin with that batch.
    """
    now = now or (lambda batch_id: F.current_timestamp().cast("timestamp_ntz"))

    def run(rows: DataFrame, batch_id: int) -> None:
        store = catalog_store(rows.sparkSession, root, rows.schema, buckets)
        done = store.version()
        if done is not None and done >= batch_id:
            return
        change, at = store.begin(batch_id), now(batch_id)
        fresh = change.keep(rows, "fresh")
        touched = store.touched(fresh)
        everything = change.keep(store.read("pending", touched).unionByName(fresh), "gathered")
        complete = everything.where("done").select("site_id", "scan_id").distinct()
        turn = F.row_number().over(Window.partitionBy("site_id").orderBy("scan_id"))
        complete = change.keep(complete.withColumn("turn", turn), "complete")
        jobs, counts = store.read("jobs", touched), store.read("waiting", touched)
        turns = complete.agg(F.max("turn")).first()[0] or 0
        if touched:
            change.put("pending", null_safe_join(everything, complete.drop("turn"), ["site_id", "scan_id"], "left_anti"), touched)
        logs = []
        for k in range(1, turns + 1):
            scanned = complete.where(F.col("turn") == k)
            scan = everything.where("not coalesce(done, false)").join(scanned, ["site_id", "scan_id"], "left_semi")
            step_ = apply_scan(jobs, counts, scanned, scan, at, keep=lambda df, tag, k=k: change.keep(df, f"{tag}-{k}"))
            logs.append(step_.history)
            jobs, counts = step_.jobs, step_.waiting
            if k < turns:
                jobs, counts = change.keep(jobs, f"jobs-{k}"), change.keep(counts, f"waiting-{k}")
        if turns:
            change.add("history", reduce(DataFrame.unionByName, logs))
            change.put("waiting", counts, touched)
            change.put("jobs", jobs, touched)
        change.commit()

    return run

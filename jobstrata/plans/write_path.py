"""From fetched pages to the catalog's next version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract, postings
from ..operators.postings import change_counts, changes_of, guarded, history_events, matched, state_after
from ..sources.sinks import written_once

#: Makes a table of a step that several others read.
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Scan:
    """What a scan leads to: the guard's answers, the events, the tables after it."""

    gate: DataFrame
    changes: DataFrame
    counts: DataFrame
    jobs: DataFrame
    waiting: DataFrame
    history: DataFrame


def apply_scan(jobs: DataFrame, waiting: DataFrame, scanned: DataFrame, scan: DataFrame, now: Column, cached: bool = False, keep: Keep = written_once) -> Scan:
    """Guard, U2, SK8: the scan's postings against the stored jobs of its sites.

    Only sites that were scanned and that the guard lets through may change;
    all other jobs are carried over as they are.  The guard's answers and the
    matched rows become tables (``keep``), since each is read several times;
    changes, history and the next jobs are projections of the latter.
    """
    gate = keep(guarded(jobs, scanned, scan, waiting, cached), "gate")
    let = gate.where("allowed").select("site_id")
    let_in = scan.join(let, "site_id", "left_semi")
    rows = keep(matched(jobs.join(let, "site_id", "left_semi"), let_in), "changes")
    changes = changes_of(rows)
    counts = gate.select("site_id", F.col("suspicious_count").cast("int").alias("suspicious_count"))
    others = waiting.select("site_id", "suspicious_count").join(gate, "site_id", "left_anti")
    after = jobs.join(let, "site_id", "left_anti").select(*jobs.columns).unionByName(state_after(rows, jobs.schema, now))
    return Scan(gate, changes, change_counts(changes, let_in), after, others.unionByName(counts), history_events(changes, now))


def postings_of_pages(pages: DataFrame, answers: DataFrame | None = None, documents: DataFrame | None = None, keep: Keep = written_once) -> DataFrame:
    """The postings of pages (page_id, site_id, page_no, url,
    html, platform), of each site once.

    A page's platform or structured data come first; where they give nothing,
    model answers and documents do.  Crawls end as E8 says.
    """
    parsed = keep(extract.extracted(pages), "parsed")  # pages are parsed once, however often their postings are read
    if answers is None and documents is None:
        found = extract.once_each(parsed)
    else:
        none = pages.sparkSession.createDataFrame([], f"page_id long, pos long, method string, {extract.POSTING}")
        found = extract.cascade(parsed, answers if answers is not None else none, documents if documents is not None else none)
    rows = postings.validated(found).join(pages.select("page_id", "site_id", "page_no", F.col("url").alias("page_url")), "page_id")
    cut = postings.all_duplicate_cut(rows, F.col("page_url"))
    return postings.deduplicated(cut, F.col("page_url"), ["site_id"], ["page_no", "pos", "page_id"])


def catalog_update(pages: DataFrame, sites: DataFrame, jobs: DataFrame, waiting: DataFrame, now: Column, answers: DataFrame | None = None, documents: DataFrame | None = None, keep: Keep = written_once) -> Scan:
    """The whole way: pages, postings, records (X29), guard, reconcile, history.

    sites: site_id and url.  Sites whose pages hold no posting are scanned too.
    """
    found = postings_of_pages(pages, answers, documents, keep).join(sites.select("site_id", F.col("url").alias("site_url")), "site_id")
    found = found.withColumn("place", F.col("page_no").cast("long") * 100_000 + F.col("pos"))
    rows = postings.records(found, F.col("site_url"), F.col("page_url"), ["place", "page_id"], ["site_id"], keep=["place", "method"])
    scan = keep(rows.withColumnsRenamed({"place": "pos", "method": "extraction_method"}), "scan")
    return apply_scan(jobs, waiting, pages.select("site_id").distinct(), scan, now, keep=keep)

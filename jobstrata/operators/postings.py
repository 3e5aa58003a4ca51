"""Filters, de-duplication and snapshot reconciliation of postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.rewrite import once


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that takes null keys for equal, as grouping does; keys come from the left."""
    keys = {c: f"__r{k}" for k, c in enumerate(by)}
    other = right.withColumnsRenamed(keys)
    on = F.lit(True)
    for c, r in keys.items():
        on = on & left[f"`{c}`"].eqNullSafe(other[r])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*keys.values())


def keep_matching_or_all(df: DataFrame, match: Column, by: list[str]) -> DataFrame:
    """The matching rows of a group, or all if none match.

    The flag is aggregated before the join back, so a group of any size costs
    one partial row per task rather than a window over all of it.  Rows with a
    null key are a group like any other.
    """
    flagged = df.withColumn("__match", F.coalesce(match, F.lit(False)))
    some = flagged.groupBy(*by).agg(F.bool_or("__match").alias("__some"))
    return null_safe_join(flagged, some, by).where("__match or not __some").drop("__match", "__some")


def by_search_query(df: DataFrame, url: str, title: str, by: list[str]) -> DataFrame:
    """postings whose title holds the page's search term."""
    # an address without any of the parameters needs none of their patterns
    asks = F.col(url).rlike(r"[?&](search|q|query|keywords?)=")
    termed = df.withColumn("__term", F.when(asks, urls.search_term(F.col(url))))
    return keep_matching_or_all(termed, F.when(F.col("__term").isNull(), True).otherwise(F.contains(F.lower(F.col(title)), F.col("__term"))), by).drop("__term")


def by_source_company(df: DataFrame, source_url: Column, by: list[str]) -> DataFrame:
    """postings that name the company the page was reached from.

    The spellings are made beside each posting: few addresses may have all the
    postings, so a join by address would send those of one to a single task.
    """
    hay = F.lower(F.concat_ws(" ", "title", "location", "company"))
    spelt = urls.company_variants(source_url)
    return keep_matching_or_all(df, once(hay, lambda h: F.exists(spelt, lambda v: F.contains(h, v))), by)


def company_if_external(df: DataFrame, careers_url: Column, source_url: Column, by: list[str], searched: bool) -> DataFrame:
    """postings of another domain are filtered, those of the site's own are not.

    On the way of discovery the search term comes first (F1), on the cached one
    (``searched`` false) only the company counts (F2).
    """
    same = urls.bare_host(careers_url) == urls.bare_host(source_url)
    own, other = df.where(F.coalesce(same, F.lit(False))), df.where(~F.coalesce(same, F.lit(False)))
    if searched:
        other = by_search_query(other, "url", "title", by)
    return own.unionByName(by_source_company(other, source_url, by))


def validated(df: DataFrame) -> DataFrame:
    """drop postings without a title and open applications; tidy the rest."""
    return df.where((F.coalesce(F.col("title"), F.lit("")) != "") & ~text.is_open_application(F.col("title"))).withColumns(
        {"title": F.trim("title"), "location": F.coalesce(F.nullif(F.trim("location"), F.lit("")), F.lit("Unknown"))}
    )


def first_in_order(df: DataFrame, by: list[str], order: list[Column], limit: Column | int) -> DataFrame:
    """The first rows of each group.

    Each group is dealt into parts that keep their own first rows; only those
    meet, so a group of any size is no single task's sort.
    """
    rows = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(64)))
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = rows.withColumn("__r", place([*by, "__part"])).where(F.col("__r") <= limit).drop("__part")
    return few.withColumn("__r", place(by)).where(F.col("__r") <= limit).withColumnRenamed("__r", "place")


#: Addresses of a sitemap that are asked about: with a keyword, and if there is none.
WITH_WORD, WITHOUT_WORD = 50, 100


def sitemap_candidates(df: DataFrame, match: Column, by: list[str], order: list[Column]) -> DataFrame:
    """The first 50 addresses with a keyword, else the first 100 of all."""
    flagged = df.withColumn("__hit", F.coalesce(match, F.lit(False)))
    some = flagged.groupBy(*by).agg(F.bool_or("__hit").alias("__some"))
    rows = null_safe_join(flagged, some, by).where("__hit or not __some")
    return first_in_order(rows, by, order, F.when(F.col("__some"), WITH_WORD).otherwise(WITHOUT_WORD)).drop("__hit", "__some", "place")


def posting_key(url: Column, base: Column) -> Column:
    """The URL if it means anything, else normalized title and location."""
    same = F.rtrim(url, F.lit("/")) == F.rtrim(base, F.lit("/"))
    clean = F.when(url.isNull() | url.isin("None", "null", "") | same | url.endswith("#"), None).otherwise(url)
    by_text = F.concat_ws("\u0001", text.normalize_title(F.col("title")), text.normalize_location(F.coalesce(F.col("location"), F.lit(""))))
    return F.when(clean.isNotNull(), F.concat(F.lit("u"), clean)).otherwise(F.concat(F.lit("t"), by_text))


def first_of_each(df: DataFrame, by: list, order: list, keep: list[str] | None = None) -> DataFrame:
    """The first row of each key, by a partial aggregate rather than a sort.

    ``keep`` names the columns that are asked for (all).  A column that is a
    key, or is named in the order, travels once.
    """
    names = keep or df.columns
    keys = {c: f"__k{k}" for k, c in enumerate(by) if isinstance(c, str)}
    places = {o: f"__o{k}" for k, o in enumerate(order) if isinstance(o, str)}
    firsts = [F.col(o).alias(places[o]) if isinstance(o, str) else o for o in order]
    rest = [F.col(c).alias(f"__v_{c}") for c in names if c not in keys and c not in places]
    keyed = df.select(*[(c if isinstance(c, Column) else F.col(c)).alias(f"__k{k}") for k, c in enumerate(by)], F.struct(*firsts, *rest).alias("__row"))
    best = keyed.groupBy(*[f"__k{k}" for k in range(len(by))]).agg(F.min("__row").alias("__row"))
    return best.select(*[F.col(keys[c] if c in keys else f"__row.{places.get(c, f'__v_{c}')}").alias(c) for c in names])


def deduplicated(df: DataFrame, base: Column, by: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """First posting of each key within a site, in page order."""
    return first_of_each(df, [*by, posting_key(F.col("url"), base)], order, keep)


CONFIRMATIONS = 3


def suspicious(previous_active: Column, found: Column) -> Column:
    """The guard: a known site lost more than half of its postings at once."""
    return (previous_active > 5) & (found < 0.5 * previous_active)


def guarded(stored: DataFrame, scanned: DataFrame, scan: DataFrame, waiting: DataFrame, cached: bool = False) -> DataFrame:
    """Guard and E3: whether each scanned site may be reconciled.

    stored: site_id, is_active; scanned: site_id of every site that was read,
    with or without postings; scan: its postings; waiting: site_id and
    suspicious_count.  A suspicious scan counts one up and is let through at
    ``CONFIRMATIONS``; an allowed scan with postings resets the count, an
    allowed empty one leaves it.  At a ``cached`` address an empty scan of a
    site that never had many postings is a failure and changes nothing.
    ``outcome`` is what the address is marked with.
    """
    active = stored.groupBy("site_id").agg(F.count_if("is_active").alias("active"))
    found = scan.groupBy("site_id").agg(F.count("*").alias("found"))
    sites = scanned.select("site_id").distinct().join(active, "site_id", "left").join(found, "site_id", "left").join(waiting.select("site_id", "suspicious_count"), "site_id", "left")
    sites = sites.fillna(0, ["active", "found", "suspicious_count"]).withColumn("suspicious", suspicious(F.col("active"), F.col("found")))
    count = F.col("suspicious_count") + F.col("suspicious").cast("int")
    failed = F.lit(cached) & (F.col("found") == 0) & ~F.col("suspicious")
    allowed = (~F.col("suspicious") | (count >= CONFIRMATIONS)) & ~failed
    good = allowed & (F.col("found") > 0)
    outcome = F.when(good, "success").when(F.col("suspicious"), "suspicious").when(failed, "failed").otherwise("empty")
    return sites.select("site_id", "active", "found", "suspicious", allowed.alias("allowed"), F.when(good, 0).otherwise(count).alias("suspicious_count"), outcome.alias("outcome"))


def keyed(df: DataFrame, name: str) -> DataFrame:
    """V3-V5 for a whole table: site_id, the keys of title and location, and the row itself as ``name``.

    Many postings share a title or a place, so each different one is rewritten
    once and joined back; a small number of them is broadcast, and a title that
    very many rows have is split by adaptive execution.  The table is read
    once more for either column, so it should be one, not a long plan.
    """
    rows = df.select("site_id", F.col("title").alias("__title"), F.col("location").alias("__location"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))
    each = lambda c, key: df.select(F.col(c).alias(f"__{c}")).distinct().withColumn(f"k_{c}", key(F.col(f"__{c}")))
    for c, key in (("title", text.sync_title), ("location", text.sync_location)):
        rows = null_safe_join(rows, each(c, key), [f"__{c}"], "left")
    return rows.select("site_id", "k_title", "k_location", name)


def first_found(scan: DataFrame, by: list[str]) -> DataFrame:
    """Of the scanned rows of one key the first (``new``): by place, title, location and address.

    Each column travels once: places are part of the row, and null ones are told
    apart from empty ones, which count alike, by a flag.
    """
    blanks = [c for c in ("location", "url") if c in scan.columns]
    rest = [c for c in scan.columns if c not in ("site_id", "pos", "title", *blanks)]
    # the flags turn the order of nulls only where all places are equal
    row = F.struct(
        F.col("r.pos").alias("pos"), F.col("r.title").alias("title"), *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in blanks],
        *[F.col(f"r.{c}").isNull().alias(f"no_{c}") for c in blanks], *[F.col(f"r.`{c}`").alias(c) for c in rest],
    )
    firsts = keyed(scan, "r").groupBy(*by).agg(F.min(row).alias("f"))
    value = lambda c: F.col("site_id") if c == "site_id" else F.when(~F.col(f"f.no_{c}"), F.col(f"f.{c}")) if c in blanks else F.col(f"f.`{c}`")
    return firsts.select(*by, F.struct(*[value(c).alias(c) for c in scan.columns]).alias("new"), F.lit(True).alias("found"))


def reconciled(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """One row for each key of stored jobs or scan, with its event.

    stored: id, site_id, title, location, is_active and any columns of a job;
    scan: site_id, title, location, pos and any columns of a job.  ``event`` is
    added, reactivated, removed, seen or null (stored, unseen and already
    inactive); ``job_id`` is the stored one, or that of the row to be added, a
    hash of its key, which doesn't depend on the partitioning; ``old`` and
    ``new`` are the stored and the scanned row.  Of stored rows with one key the
    highest id counts, of scanned ones the first place.
    """
    by = ["site_id", "k_title", "k_location"]
    old = keyed(stored, "r").groupBy(*by).agg(F.max_by("r", "r.id").alias("old"), F.lit(True).alias("known"))
    new = first_found(scan, by)
    both = old.join(new, by, "full_outer")
    known, found, active = F.coalesce("known", F.lit(False)), F.coalesce("found", F.lit(False)), F.col("old.is_active")
    event = (
        F.when(~known, "added").when(found & active, "seen").when(found & ~active, "reactivated").when(~found & active, "removed")
    )
    job_id = F.coalesce("old.id", F.xxhash64(*by))
    return both.select(*by, job_id.alias("job_id"), F.coalesce("new.title", "old.title").alias("title"), event.alias("event"), "old", "new")


def matched(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """U2 for a whole table: one row for each stored job, and one for each key that is new.

    The same as ``reconciled``, but stored rows aren't aggregated: of those with
    one key, ``latest`` marks the one that counts, and only it has an event.
    Both sides are dealt out once, by key.
    """
    by = ["site_id", "k_title", "k_location"]
    newest = F.col("old.id").eqNullSafe(F.max("old.id").over(Window.partitionBy(*by)))
    old = keyed(stored, "old").withColumn("is_newest", newest)
    new = first_found(scan, by)
    both = old.join(new, by, "full_outer")
    known, found, active = F.col("is_newest").isNotNull(), F.coalesce("found", F.lit(False)), F.col("old.is_active")
    latest = ~known | F.col("is_newest")
    event = F.when(latest, F.when(~known, "added").when(found & active, "seen").when(found & ~active, "reactivated").when(~found & active, "removed"))
    job_id = F.coalesce("old.id", F.xxhash64(*by))
    return both.select(*by, job_id.alias("job_id"), F.coalesce("new.title", "old.title").alias("title"), event.alias("event"), "old", F.when(latest, F.col("new")).alias("new"), latest.alias("latest"))


def changes_of(rows: DataFrame) -> DataFrame:
    """``reconciled`` from what ``matched`` gives."""
    return rows.where("latest").drop("latest")


def _after(now: Column) -> dict[str, Column]:
    """What a stored row's columns become, by its ``event``."""
    return {
        "is_active": F.when(F.col("event") == "reactivated", True).when(F.col("event") == "removed", False),
        "last_seen_at": F.when(F.col("event").isin("seen", "reactivated"), now),
    }


def state_after(rows: DataFrame, schema, now: Column) -> DataFrame:
    """The jobs table after a scan, from what ``matched`` gives: a projection, no join.

    schema: that of the jobs table.
    """
    names, have = set(rows.schema["old"].dataType.names), set(rows.schema["new"].dataType.names)
    fresh = {"id": F.col("job_id"), "is_active": F.lit(True), "last_seen_at": now, "first_seen_at": now}
    added, sets = F.col("event").eqNullSafe("added"), _after(now)

    def value(f) -> Column:
        kept = F.col(f"old.`{f.name}`") if f.name in names else F.lit(None)
        if f.name in sets:
            kept = F.coalesce(sets[f.name].cast(f.dataType), kept)
        new = fresh[f.name] if f.name in fresh else F.col(f"new.`{f.name}`") if f.name in have else F.lit(None)
        return F.when(added, new.cast(f.dataType)).otherwise(kept.cast(f.dataType)).alias(f.name)

    return rows.select(*map(value, schema))


def next_state(stored: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The jobs table after a scan, with all its columns: touched, switched and new rows.

    A job seen again changes nothing but ``last_seen_at`` (and ``is_active``);
    a new one keeps title and location as they were found.
    """
    changed = changes.where("event in ('seen', 'reactivated', 'removed')").select(F.col("job_id").alias("id"), "event")
    sets = {
        "is_active": F.when(F.col("event") == "reactivated", True).when(F.col("event") == "removed", False).otherwise(F.col("is_active")),
        "last_seen_at": F.when(F.col("event").isin("seen", "reactivated"), now).otherwise(F.col("last_seen_at")),
    }
    old = stored.join(changed, "id", "left").select(*[sets.get(c, F.col(f"`{c}`")).alias(c) for c in stored.columns])
    have = set(changes.schema["new"].dataType.names)
    fresh = {"id": F.col("job_id"), "is_active": F.lit(True), "last_seen_at": now, "first_seen_at": now}
    value = lambda c: fresh[c] if c in fresh else F.col(f"new.`{c}`") if c in have else F.lit(None)
    added = changes.where("event = 'added'").select(*[value(f.name).cast(f.dataType).alias(f.name) for f in stored.schema])
    return old.unionByName(added)


def history_events(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """SK8: the rows to append to the history."""
    details = F.when(F.col("event") == "removed", "Job no longer found on site").when(F.col("event") == "reactivated", "Job reappeared after being removed")
    out = changes.where("event in ('added', 'removed', 'reactivated')").select("site_id", "job_id", "event", details.alias("details"))
    return out if now is None else out.withColumn("changed_at", now)


def removed_postings(changes: DataFrame) -> DataFrame:
    """U2, step 7: removed jobs as postings, from what is stored of them."""
    names = changes.schema["old"].dataType.names
    of = lambda c: F.col(f"old.{c}") if c in names else F.lit(None).cast("string")
    return changes.where("event = 'removed'").select(
        F.concat(F.lit("cached-"), F.col("job_id")).alias("id"), of("title").alias("title"), F.coalesce(of("company"), F.lit("")).alias("company"),
        F.coalesce(of("location"), F.lit("Unknown")).alias("location"), F.coalesce(of("url"), F.lit("")).alias("url"),
        F.concat(F.lit("cached:"), F.col("site_id")).alias("source"), of("title_en").alias("title_en"),
    )


def change_counts(changes: DataFrame, scan: DataFrame) -> DataFrame:
    """What a scan changed at each site; ``total_jobs`` counts before de-duplication."""
    e = F.col("event")
    counts = changes.groupBy("site_id").agg(
        F.count_if(e == "added").alias("new_jobs"), F.count_if(e == "removed").alias("removed_jobs"), F.count_if(e == "reactivated").alias("reactivated_jobs"),
        (F.count("old") == 0).alias("is_first_scan"),
    )
    total = scan.groupBy("site_id").agg(F.count("*").alias("total_jobs"))
    out = counts.join(total, "site_id", "left").fillna(0, ["total_jobs"])
    return out.withColumn("has_changes", F.col("new_jobs") + F.col("removed_jobs") + F.col("reactivated_jobs") > 0)


#: How many titles of each event a summary shows (fixed values).
SHOWN = {"added": 5, "removed": 5, "reactivated": 3}


def change_summary(changes: DataFrame) -> DataFrame:
    """SK6, T8: for each site and event, the first titles and how many more there are.

    Only the first few of a group are ever held.
    """
    rows = changes.where(F.col("event").isin(*SHOWN))
    limit = F.coalesce(*[F.when(F.col("event") == e, F.lit(n)) for e, n in SHOWN.items()])
    counts = rows.groupBy("site_id", "event").agg(F.count("*").alias("n"))
    few = first_in_order(rows, ["site_id", "event"], [F.col("k_title"), F.col("k_location")], limit)
    shown = few.groupBy("site_id", "event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "; ").alias("first_titles"))
    return counts.join(shown, ["site_id", "event"]).select("site_id", "event", "n", "first_titles", F.greatest(F.col("n") - limit, F.lit(0)).alias("more"))


def records(rows: DataFrame, site_url: Column, careers_url: Column, order: list[str], by: list[str], keep: list[str] | None = None) -> DataFrame:
    """Postings of a page as job records.

    The id counts the postings of a group (``by``) in ``order``; the company is
    that of the site's address, whatever the page says; titles that have no
    translation keep none; ``keep`` names further columns.  Groups are numbered from sums over blocks of the
    order's first column, so a group of any size is no single task's sort.
    """
    names = rows.columns
    has = lambda c, other: F.coalesce(F.col(c), other) if c in names else other
    number = _numbered(rows.withColumns({"__host": urls.host(site_url), "__careers": careers_url}), by, order)
    return number.select(
        *by, F.concat(F.lit("web-"), F.col("__host"), F.lit("-"), F.col("__n").cast("string")).alias("external_id"),
        has("title", F.lit("Unknown Position")).alias("title"), text.company_name(F.col("__host")).alias("company"), has("location", F.lit("Unknown")).alias("location"),
        has("url", F.col("__careers")).alias("url"), F.concat(F.lit("website:"), F.col("__host")).alias("source"),
        (F.col("title_en") if "title_en" in names else F.lit(None).cast("string")).alias("title_en"), *(keep or []),
    )


#: Blocks into which the first column of an order is cut.
BLOCK = 1024


def _numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Places (``__n``, from 0) of rows within their group, in two steps; nulls come first."""
    block = F.floor(F.col(order[0]) / BLOCK)
    rows = df.withColumn("__b", block)
    sums = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1
    return null_safe_join(rows, sums.select(*by, "__b", before.alias("__before")), [*by, "__b"]).withColumn("__n", F.col("__before") + place).drop("__b", "__before")


#: Pages of a crawl (a fixed value).
MAX_PAGES = 3


def followed_pages(starts: DataFrame, pages: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """The pages a crawl visits, from its start along next-page links.

    starts: site_id, url; pages: url (each once) and next_page_url, as landed.
    Gives site_id, page_no (from 1) and url of at most ``limit`` pages of each
    start, one join for each further page.  A link to a page that has not been
    landed ends the crawl there; a loop visits a page again, until the limit or
    until ``all_duplicate_cut`` finds nothing new on it.
    """
    links = pages.select(F.col("url").alias("__url"), F.col("next_page_url").alias("__next"))
    here = starts.select("site_id", F.col("url").alias("__at"))
    visited = []
    for page_no in range(1, limit + 1):
        here = here.join(links, F.col("__at") == F.col("__url")).select("site_id", F.lit(page_no).alias("page_no"), F.col("__url").alias("url"), F.nullif("__next", F.lit("")).alias("__at"))
        visited.append(here.drop("__at"))
    return reduce(DataFrame.unionByName, visited)


def with_translations(titles: DataFrame, titles_col: str = "titles", translations_col: str = "translations") -> DataFrame:
    """Titles and their translations, two arrays in one order, as rows (pos, title, title_en).

    A title past the end of its translations has none; translations past the
    end of the titles are passed over, and so are rows without titles.
    """
    others = [F.col(f"`{c}`") for c in titles.columns if c not in (titles_col, translations_col)]
    rows = titles.select(*others, F.col(translations_col).alias("__said"), F.posexplode(titles_col).alias("pos", "title"))
    return rows.select(*others, "pos", "title", F.get("__said", F.col("pos")).alias("title_en"))


def all_duplicate_cut(df: DataFrame, base: Column) -> DataFrame:
    """Pages of a crawl up to the third, or to the first non-empty page without a new posting."""
    keyed = df.where("page_no <= 3").withColumn("__key", posting_key(F.col("url"), base))
    fresh = keyed.groupBy("site_id", "__key").agg(F.min("page_no").alias("__first"))
    pages = keyed.select("site_id", "page_no", "__key").distinct().join(fresh, ["site_id", "__key"])
    stale = pages.groupBy("site_id", "page_no").agg(F.bool_or(F.col("__first") == F.col("page_no")).alias("new")).where("not new")
    cut = stale.groupBy("site_id").agg(F.min("page_no").alias("__cut"))
    return keyed.join(cut, "site_id", "left").where("__cut is null or page_no <= __cut").drop("__cut", "__key")


def with_running_heading(df: DataFrame, by: list[str], order: str, heading: str, name: str, block: int = BLOCK) -> DataFrame:
    """The last heading at or above each row of a group, in ``order`` (numbers; a key of the group).

    Rows look up within their block of the order; what stands above a block is
    the last heading of the blocks before it, so no group is one task's sort.
    Rows above the first heading have none.
    """
    rows = df.withColumn("__b", F.floor(F.col(order) / block))
    inside = F.last(heading, ignorenulls=True).over(Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where(F.col(heading).isNotNull()).groupBy(*by, "__b").agg(F.max_by(heading, order).alias("__end"))
    every = null_safe_join(rows.select(*by, "__b").distinct(), ends, [*by, "__b"], "left")
    above = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = every.select(*by, "__b", above.alias("__above")).where("__above is not null")
    return null_safe_join(rows.withColumn("__in", inside), blocks, [*by, "__b"], "left").withColumn(name, F.coalesce("__in", "__above")).drop("__b", "__in", "__above")

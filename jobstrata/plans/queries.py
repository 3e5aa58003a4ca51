"""Queries over the catalog, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.rewrite import lookup, quote
from ..operators import enrich, extract, markup, postings, reports, state
from ..sources.sinks import written_once
from .catalog import relation, with_relations
from .write_path import apply_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *relations: str):
    """Register ``f(relation DataFrames...)`` under a name with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(relation(spark, sf_dir, r) for r in relations))
        if sql is not None:
            SQL[name] = with_relations(sql, *relations)
        return f

    return register


def scalar(name: str, source: str, columns: dict[str, tuple], keys: tuple[str, ...] = ("id",)) -> None:
    """A projection: column -> (Spark expression, made when asked for, and SQL)."""
    cols = ", ".join(f"{s} AS {c}" for c, (_, s) in columns.items())
    query(name, f"SELECT {', '.join(keys)}, {cols} FROM {source}", source)(lambda df: df.select(*keys, *[e().alias(c) for c, (e, _) in columns.items()]))



scalar("v1_v2_normalized", "postings", {"title_key": (lambda: text.normalize_title(F.col("title")), text.normalize_title_sql("title")), "location_key": (lambda: text.normalize_location(F.col("location")), text.normalize_location_sql("location"))})
query("v3_v4_v5_sync_key", f"SELECT id, {text.sync_title_sql('title')} AS title_key, {text.sync_location_sql('location')} AS location_key FROM postings", "postings")(
    lambda df: postings.keyed(df, "r").select("r.id", F.col("k_title").alias("title_key"), F.col("k_location").alias("location_key"))
)
scalar("v6_v7_candidate_title", "postings", {"fixed": (lambda: text.unrepeated(F.col("title")), text.unrepeated_sql("title")), "candidate": (lambda: text.candidate_title(F.col("title")), text.candidate_title_sql("title"))})
_file = lambda: F.concat(F.lit("4pipes_Stellenausschreibung_"), F.regexp_replace(F.trim("title"), " ", "_"), F.lit("_it-systemadmin_v2_20251027.pdf"))
scalar("v8_filename_title", "postings", {"from_file": (lambda: text.filename_title(_file()), text.filename_title_sql("('4pipes_Stellenausschreibung_' || replace(trim(title), ' ', '_') || '_it-systemadmin_v2_20251027.pdf')"))})
scalar("v9_v10_slugs", "postings", {
    "title_slug": (lambda: text.slug(F.col("title")), text.slug_sql("title")),
    "de_slug": (lambda: text.location_slug(F.coalesce(F.col("location"), F.lit("München")), text.CITIES_DE), text.location_slug_sql("coalesce(location, 'München')", text.CITIES_DE)),
    "at_slug": (lambda: text.location_slug(F.coalesce(F.col("location"), F.lit("Österreich")), text.CITIES_AT), text.location_slug_sql("coalesce(location, 'Österreich')", text.CITIES_AT)),
})
scalar("v20_f20_translation", "postings", {"title_en": (lambda: text.translated(F.col("title")), text.translated_sql("title")), "english": (lambda: text.looks_english(F.col("title")), text.looks_english_sql("title"))})
_host = lambda: urls.host(F.coalesce(F.col("url"), F.lit("")))
scalar("v21_company_name", "postings", {"company_name": (lambda: text.company_name(_host()), text.company_name_sql(urls.host_sql("coalesce(url, '')")))})
_pay = lambda: (F.expr("cast(id % 4 * 1500 as int)"), F.expr("cast(id % 3 * 2500000 as int)"), F.expr("case when id % 5 = 0 then null when id % 5 = 1 then '' else 'EUR' end"))
scalar("v22_salary_display", "postings", {"salary": (lambda: text.salary_display(*_pay()), text.salary_display_sql("(id % 4 * 1500)", "(id % 3 * 2500000)", "(CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE 'EUR' END)"))})
_sig = {"has_gender_notation": "contains(title, '(m/w/d)')", "has_location": "location IS NOT NULL", "proper_length": "length(title) > 15", "too_short": "length(title) < 10", "has_non_job_words": "contains(lower(title), 'impressum')"}
scalar("v23_confidence", "postings", {"confidence": (lambda: text.confidence(F.col("method"), {k: F.expr(v) for k, v in _sig.items()}), text.confidence_sql("method", _sig))})
scalar("v24_tokens", "cache", {"tokens": (lambda: F.expr("cast(length(content) div 4 as long)"), "(length(content) // 4)::BIGINT")})
scalar("v25_cache_key", "cache", {"key": (lambda: text.cache_key(F.col("namespace"), F.col("content"), F.col("model")), text.cache_key_sql("namespace", "content", "model"))})
scalar("v29_retry_after", "fetches", {"wait": (lambda: state.retry_after_seconds(F.col("retry_after")), "CASE WHEN regexp_matches(retry_after, '^\\d+$') THEN nullif(retry_after::DOUBLE, 0) END")})
scalar("v31_expired", "cache", {"live": (lambda: state.is_live(F.col("created_at"), F.col("ttl_seconds"), F.lit(4000)), "created_at + ttl_seconds > 4000"), "purged": (lambda: state.is_purged(F.col("created_at"), F.col("ttl_seconds"), F.lit(4000)), "created_at + ttl_seconds < 4000")})
_posted = "(CASE id % 4 WHEN 0 THEN concat('/stellenangebote--', id, '--', site_id, '?rltr=1') WHEN 1 THEN concat('/x--', id) WHEN 2 THEN concat('/x--', id, '/y') ELSE url END)"
scalar("v32_job_id_from_url", "postings", {"job_id": (lambda: urls.posting_number(F.expr(_posted), F.col("page_no").cast("string")), f"coalesce(nullif(regexp_extract(coalesce({_posted}, ''), '--(\\d+)(?:\\?|$)', 1), ''), page_no::VARCHAR)")})
scalar("f3_f4_open_application", "postings", {"open_application": (lambda: text.is_open_application(F.col("title")), text.is_open_application_sql("title"))})
scalar("f6_title_classifier", "postings", {"verdict": (lambda: text.title_verdict(F.col("title")), text.title_verdict_sql("title"))})
scalar("f13_l4_platform", "postings", {"platform": (lambda: urls.platform(F.col("url")), urls.platform_sql("url")), "board_url": (lambda: urls.board_url(F.col("url"), urls.platform(F.col("url"))), urls.board_url_sql("url", urls.platform_sql("url")))})
scalar("f9_f16_url_predicates", "postings", {"board_page": (lambda: urls.is_board_page(F.col("url")), urls.is_board_page_sql("url")), "careers": (lambda: urls.is_careers_url(F.col("url")), urls.is_careers_url_sql("url"))})
scalar("f23_fetch_outcome", "fetches", {"outcome": (lambda: reports.outcome(F.col("status")), (
    "CASE WHEN status IN (429, 503) THEN 'limited' WHEN status = 403 OR status BETWEEN 520 AND 526 THEN 'challenge' WHEN status BETWEEN 200 AND 399 THEN 'ok' "
    "WHEN status BETWEEN 400 AND 499 THEN 'client_error' ELSE 'server_error' END"
))})
scalar("l1_full_url", "postings", {"full": (lambda: urls.full_url(F.expr("case when id % 5 = 0 then '/job/1' when id % 5 = 1 then 'job/2' when id % 5 = 2 then '//cdn.x/y' when id % 5 = 3 then '?a=1' else '' end"), F.coalesce(F.col("url"), F.lit("https://a.b/c"))), urls.full_url_sql("(CASE WHEN id % 5 = 0 THEN '/job/1' WHEN id % 5 = 1 THEN 'job/2' WHEN id % 5 = 2 THEN '//cdn.x/y' WHEN id % 5 = 3 THEN '?a=1' ELSE '' END)", "coalesce(url, 'https://a.b/c')"))})
scalar("l3_l9_l11_url_parts", "postings", {"clean": (lambda: urls.without_query(F.col("url")), urls.without_query_sql("url")), "host": (lambda: urls.bare_host(F.col("url")), urls.bare_host_sql("url")), "term": (lambda: urls.search_term(F.col("url")), urls.search_term_sql("url"))})
query("l5_url_variants", f"SELECT id, unnest({urls.variants_sql('url')}) AS variant FROM career_urls", "career_urls")(lambda df: df.select("id", F.explode(urls.variants(F.col("url"))).alias("variant")))
query("l6_alternative_urls", f"SELECT id, rtrim({urls.origin_sql('url')}, '/') || unnest([{urls.listed(urls.ALTERNATIVES)}]) AS alternative FROM career_urls", "career_urls")(
    lambda df: df.select("id", F.explode(F.array(*[F.concat(F.rtrim(urls.origin(F.col("url")), F.lit("/")), F.lit(a)) for a in urls.ALTERNATIVES])).alias("alternative"))
)
query("l7_career_subdomains", f"SELECT id, 'https://' || unnest([{urls.listed(urls.SUBDOMAINS)}]) || '.' || domain AS candidate FROM sites", "sites")(
    lambda df: df.select("id", F.explode(F.array(*[F.concat(F.lit(f"https://{s}."), "domain") for s in urls.SUBDOMAINS])).alias("candidate"))
)

# --- filters, de-duplication, reconciliation --------------------------------------

_BASE = "https://acme.example/jobs/"
query("f1_search_filter", (
    f"SELECT id, title FROM (SELECT *, m, bool_or(m) OVER (PARTITION BY nullif(site_id, 7), page_no) AS any_match "
    f"FROM (SELECT *, coalesce({urls.search_term_sql('url')} IS NULL OR contains(lower(title), {urls.search_term_sql('url')}), false) AS m "
    f"FROM postings)) WHERE m OR NOT any_match"
), "postings")(
    lambda df: postings.by_search_query(df.withColumn("site", F.expr("nullif(site_id, 7)")), "url", "title", ["site", "page_no"]).select("id", "title")
)
_src = "CASE WHEN site_id % 2 = 0 THEN 'https://www.2rsoftware.de/' ELSE 'https://my-company.com/x' END"
query("f2_company_filter", (
    f"SELECT id, title FROM (SELECT *, bool_or(m) OVER (PARTITION BY nullif(site_id, 7)) AS any_match "
    f"FROM (SELECT *, len(list_filter({urls.company_variants_sql('(' + _src + ')')}, lambda v: contains(lower(concat_ws(' ', title, location, company)), v))) "
    f"> 0 AS m FROM postings)) WHERE m OR NOT any_match"
), "postings")(
    lambda df: postings.by_source_company(df.withColumn("site", F.expr("nullif(site_id, 7)")), F.expr(_src), ["site"]).select("id", "title")
)
query("f5_validated", (
    f"SELECT id, trim(title) AS title, coalesce(nullif(trim(location), ''), 'Unknown') AS location, url "
    f"FROM postings WHERE coalesce(title, '') <> '' AND NOT {text.is_open_application_sql('title')}"
), "postings")(
    lambda df: postings.validated(df).select("id", "title", "location", "url")
)
_key_sql = (
    "CASE WHEN url IS NULL OR url IN ('None', 'null', '') OR rtrim(url, '/') = 'https://acme.example/jobs' OR ends_with(url, '#') "
    f"THEN 't' || {text.normalize_title_sql('title')} || chr(1) || {text.normalize_location_sql('''coalesce(location, '')''')} ELSE 'u' || url END"
)
query("u1_deduplicated", f"SELECT id, title, url FROM (SELECT *, row_number() OVER (PARTITION BY site_id, {_key_sql} ORDER BY page_no, pos, id) AS n FROM postings) WHERE n = 1", "postings")(
    lambda df: postings.deduplicated(df, F.lit(_BASE), ["site_id"], ["page_no", "pos", "id"], ["id", "title", "url"])
)
query("u1c_candidate_dedup", f"SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY site_id, {text.candidate_title_sql('title')} ORDER BY id) AS n FROM postings) WHERE n = 1", "postings")(
    lambda df: postings.first_of_each(df, ["site_id", text.candidate_title(F.col("title"))], ["id"], ["id", "title"])
)
_NOW = 10**9
_blank = lambda c: f"coalesce({c}, '')"


def _sync_sql(scan: str, jobs: str = "jobs") -> str:
    """DuckDB: c, one row for each key of jobs and of a scan; each title and place is rewritten once."""
    row = "{'title': title, 'location': location, 'url': url" + (", 'company': company" if scan == "postings" else "") + "}"
    keyed = lambda t: f"(SELECT x.*, kt, kl FROM {t} x JOIN kts ON x.title IS NOT DISTINCT FROM kts.title JOIN kls ON x.location IS NOT DISTINCT FROM kls.location)"
    return f"""
kts AS MATERIALIZED (SELECT title, {text.sync_title_sql('title')} AS kt FROM (SELECT title FROM {jobs} UNION SELECT title FROM {scan})),
kls AS MATERIALIZED (SELECT location, {text.sync_location_sql('location')} AS kl FROM (SELECT location FROM {jobs} UNION SELECT location FROM {scan})),
o AS (SELECT site_id, kt, kl, max(id) AS job_id, arg_max(is_active, id) AS active,
  arg_max({{'title': title, 'location': location, 'url': url, 'company': company}}, id) AS was FROM {keyed(jobs)} GROUP BY site_id, kt, kl),
n AS (SELECT site_id, kt, kl, arg_min({row}, (pos, title, {_blank('location')}, {_blank('url')})) AS r FROM {keyed(scan)} GROUP BY site_id, kt, kl),
c AS MATERIALIZED (SELECT coalesce(o.site_id, n.site_id) AS site_id, coalesce(o.kt, n.kt) AS k_title, coalesce(o.kl, n.kl) AS k_location, job_id, was, r, coalesce(r.title, was.title) AS title,
  CASE WHEN o.site_id IS NULL THEN 'added' WHEN n.site_id IS NOT NULL AND active THEN 'seen' WHEN n.site_id IS NOT NULL THEN 'reactivated' WHEN active THEN 'removed' END AS event
  FROM o FULL JOIN n ON o.site_id = n.site_id AND o.kt = n.kt AND o.kl = n.kl)"""


_SYNC = _sync_sql("postings")
_DETAILS = "CASE event WHEN 'removed' THEN 'Job no longer found on site' WHEN 'reactivated' THEN 'Job reappeared after being removed' END"
#: What a change is told from: other columns aren't dealt out.
_JOB, _FOUND = ["id", "site_id", "title", "location", "is_active"], ["site_id", "pos", "title", "location"]
_sync = lambda j, p: postings.reconciled(j.select(*_JOB), p.select(*_FOUND))
_now = lambda: F.lit(_NOW).cast("long")
_stored = lambda c="job_id": F.when(F.col("event") != "added", F.col(c))  # noqa: E731  ids of new jobs are hashes that DuckDB lacks
query("u2_j3_reconciled", f", {_SYNC} SELECT site_id, k_title, k_location, job_id, event FROM c", "jobs", "postings")(
    lambda j, p: _sync(j, p).select("site_id", "k_title", "k_location", F.when(F.col("old").isNotNull(), F.col("job_id")).alias("job_id"), "event")
)
query("a9_change_counts", (
    f", {_SYNC}, t AS (SELECT site_id, count(*) AS total FROM postings GROUP BY 1) SELECT c.site_id, count(*) FILTER (event = 'added') AS new_jobs, count(*) "
    f"FILTER (event = 'removed') AS removed_jobs, count(*) FILTER (event = 'reactivated') AS reactivated_jobs, count(job_id) = 0 AS is_first_scan, coalesce(max(total), "
    f"0) AS total_jobs, coalesce(bool_or(event IN ('added', 'removed', 'reactivated')), false) AS has_changes "
    f"FROM c LEFT JOIN t ON t.site_id = c.site_id GROUP BY c.site_id"
), "jobs", "postings")(
    lambda j, p: postings.change_counts(_sync(j, p), p)
)
# every event with the job that its id leads to in the next version: ids of added jobs must be those of the rows that were added
query("sk8_history_events", (
    f", {_SYNC} SELECT site_id, CASE WHEN event <> 'added' THEN job_id END AS job_id, event, {_DETAILS} AS details, {_NOW}::BIGINT AS changed_at, CASE WHEN event "
    f"= 'added' THEN r.title ELSE was.title END AS title, CASE WHEN event = 'added' THEN r.location ELSE was.location END AS location, event <> 'removed' AS "
    f"is_active FROM c WHERE event IN ('added', 'removed', 'reactivated')"
), "jobs", "postings")(
    lambda j, p: _events_with_jobs(j.select(*_JOB), p.select(*_FOUND))
)


def _events_with_jobs(jobs: DataFrame, scan: DataFrame) -> DataFrame:
    rows = written_once(postings.matched(jobs, scan), "matched")
    after = postings.state_after(rows, jobs.schema, _now()).select(F.col("id").alias("job_id"), "title", "location", "is_active")
    events = postings.history_events(postings.changes_of(rows), _now()).join(after, "job_id")
    return events.select("site_id", _stored().alias("job_id"), "event", "details", "changed_at", "title", "location", "is_active")


_STATE_SQL = f"""SELECT j.id, j.site_id, j.title, j.location, j.url, j.company, CASE WHEN c.event = 'reactivated' THEN true WHEN c.event = 'removed' THEN false ELSE j.is_active END AS is_active,
  j.first_seen_at, CASE WHEN c.event IN ('seen', 'reactivated') THEN {_NOW} ELSE j.last_seen_at END::BIGINT AS last_seen_at FROM jobs j LEFT JOIN c ON c.job_id = j.id"""
query("u2_next_state", f", {_SYNC} {_STATE_SQL} UNION ALL SELECT NULL, site_id, r.title, r.location, r.url, r.company, true, {_NOW}, {_NOW} FROM c WHERE event = 'added'", "jobs", "postings")(
    lambda j, p: postings.state_after(postings.matched(j, p.select(*_FOUND, "url", "company")), j.schema, _now()).withColumn("id", F.when(F.col("first_seen_at") != _NOW, F.col("id")))
)
query("u2_removed_postings", (
    f", {_SYNC} SELECT 'cached-' || job_id AS id, was.title AS title, coalesce(was.company, '') AS company, coalesce(was.location, 'Unknown') AS location, coalesce(was.url, "
    f"'') AS url, 'cached:' || site_id AS source, NULL::VARCHAR AS title_en FROM c WHERE event = 'removed'"
), "jobs", "postings")(
    lambda j, p: postings.removed_postings(postings.reconciled(j, p.select(*_FOUND)))
)
query("sk6_t8_change_summary", (
    f", {_SYNC}, a AS (SELECT site_id, event, count(*) AS n, list(title ORDER BY k_title, k_location) AS titles "
    f"FROM c WHERE event IN ('added', 'removed', 'reactivated') GROUP BY ALL) SELECT site_id, event, n, array_to_string(titles[1:CASE event WHEN 'reactivated' "
    f"THEN 3 ELSE 5 END], '; ') AS first_titles, greatest(n - CASE event WHEN 'reactivated' THEN 3 ELSE 5 END, 0) AS more "
    f"FROM a"
), "jobs", "postings")(
    lambda j, p: postings.change_summary(_sync(j, p))
)

_GATE = """w AS (SELECT site_id, max(suspicious_count) AS waiting FROM career_urls GROUP BY 1), f AS (SELECT site_id, count(*) AS found FROM rescan GROUP BY 1), a AS (SELECT site_id, count(*) FILTER (is_active) AS active FROM jobs GROUP BY 1),
q AS (SELECT s.id AS site_id, coalesce(active, 0) AS active, coalesce(found, 0) AS found, coalesce(active, 0) > 5 AND coalesce(found, 0) < 0.5 * coalesce(active, 0) AS suspicious, coalesce(waiting, 0) AS waiting
  FROM sites s LEFT JOIN w ON w.site_id = s.id LEFT JOIN f ON f.site_id = s.id LEFT JOIN a ON a.site_id = s.id),
g AS (SELECT site_id, active, found, suspicious, NOT suspicious OR waiting + 1 >= 3 AS allowed, CASE WHEN (NOT suspicious OR waiting + 1 >= 3) AND found > 0 THEN 0 ELSE waiting + suspicious::INT END AS suspicious_count,
  CASE WHEN (NOT suspicious OR waiting + 1 >= 3) AND found > 0 THEN 'success' WHEN suspicious THEN 'suspicious' ELSE 'empty' END AS outcome FROM q)"""
_waiting = lambda u: u.groupBy("site_id").agg(F.max("suspicious_count").alias("suspicious_count"))
_scan_of = lambda j, u, s, p: apply_scan(j, _waiting(u), s.select(F.col("id").alias("site_id")), p, _now())
query("guard_e3_confirmed", f", {_GATE} SELECT * FROM g", "jobs", "career_urls", "sites", "rescan")(lambda j, u, s, p: _scan_of(j, u, s, p).gate)
_LET = f"""{_GATE}, l AS (SELECT site_id FROM g WHERE allowed), let_jobs AS (SELECT * FROM jobs WHERE site_id IN (SELECT site_id FROM l)),
let_scan AS (SELECT * FROM rescan WHERE site_id IN (SELECT site_id FROM l)),"""
_GATED = _sync_sql("let_scan", "let_jobs")
query("u2_guarded_next_state", (
    f", {_LET} {_GATED} {_STATE_SQL} UNION ALL SELECT NULL, site_id, r.title, r.location, r.url, NULL, true, {_NOW}, {_NOW} "
    f"FROM c WHERE event = 'added'"
), "jobs", "career_urls", "sites", "rescan")(
    lambda j, u, s, p: _scan_of(j, u, s, p).jobs.withColumn("id", F.when(F.col("first_seen_at") != _NOW, F.col("id")))
)
query("e1_e2_e3_marked_urls", f""", o AS (SELECT id, CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'suspicious' END AS o FROM career_urls)
SELECT u.id, CASE o WHEN 'success' THEN 0 WHEN 'failed' THEN fail_count + 1 ELSE fail_count END::INT AS fail_count, CASE o WHEN 'success' THEN 0 WHEN 'suspicious' THEN suspicious_count + 1 ELSE suspicious_count END::INT AS suspicious_count,
  CASE WHEN o = 'success' THEN true WHEN o = 'failed' AND fail_count + 1 >= 3 THEN false ELSE is_active END AS is_active, CASE WHEN o = 'success' THEN {_NOW} ELSE last_success_at END::BIGINT AS last_success_at FROM career_urls u JOIN o ON o.id = u.id""", "career_urls")(
    lambda u: state.marked(u, u.select("id", F.expr("case id % 4 when 0 then 'success' when 1 then 'failed' when 2 then 'suspicious' end").alias("outcome")), _now()).select("id", "fail_count", "suspicious_count", "is_active", "last_success_at")
)
query("f22_company_if_external", (
    f"SELECT id, title FROM (SELECT *, bool_or(m) OVER (PARTITION BY site_id, own) AS any_match FROM (SELECT *, site_id % 3 = 0 AS own, len(list_filter({urls.company_variants_sql('(' + _src + ')')}, "
    f"lambda v: contains(lower(concat_ws(' ', title, location, company)), v))) > 0 AS m FROM postings)) "
    f"WHERE own OR m OR NOT any_match"
), "postings")(
    lambda df: postings.company_if_external(df, F.expr(f"case when site_id % 3 = 0 then {_src} else 'https://jobs.lever.co/x' end"), F.expr(_src), ["site_id"], False).select("id", "title")
)
query("e8_crawl_cut", (
    f", k AS (SELECT *, {_key_sql} AS k FROM postings WHERE page_no <= 3), f AS (SELECT *, min(page_no) "
    f"OVER (PARTITION BY site_id, k) AS first FROM k), s AS (SELECT site_id, min(page_no) AS cut "
    f"FROM (SELECT site_id, page_no FROM f GROUP BY ALL HAVING NOT bool_or(first = page_no)) GROUP BY 1) "
    f"SELECT id, f.site_id, page_no FROM f LEFT JOIN s ON s.site_id = f.site_id WHERE cut IS NULL OR page_no <= cut"
), "postings")(
    lambda df: postings.all_duplicate_cut(df, F.lit(_BASE)).select("id", "site_id", "page_no")
)

# --- upserts -----------------------------------------------------------------------

_new_urls = lambda df: df.select((F.col("id") * 2).alias("id"), "site_id", F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("?n"))).alias("url"), F.nullif("platform", F.lit("")).alias("platform")).groupBy("site_id", "url").agg(F.max("id").alias("id"), F.max("platform").alias("platform"))


def _upsert_urls(df: DataFrame) -> DataFrame:
    old = df.groupBy("site_id", "url").agg(F.max("id").alias("id"), F.max("platform").alias("platform"), F.bool_or("is_active").alias("is_active"), F.max("fail_count").alias("fail_count"), F.max("suspicious_count").alias("suspicious_count"))
    update = {"is_active": F.lit(True), "fail_count": F.lit(0), "platform": F.coalesce("new.platform", "old.platform")}
    insert = {"is_active": F.lit(True), "fail_count": F.lit(0), "suspicious_count": F.lit(0)}
    return state.upserted(old, _new_urls(df), ["site_id", "url"], update, insert)


query("u4_career_url_upsert", """, o AS (SELECT site_id, url, max(id) AS id, max(platform) AS platform, bool_or(is_active) AS is_active, max(fail_count) AS fail_count, max(suspicious_count) AS suspicious_count FROM career_urls GROUP BY ALL),
n AS (SELECT site_id, url, max(id) AS id, max(platform) AS platform FROM (SELECT id * 2 AS id, site_id, CASE WHEN id % 2 = 0 THEN url ELSE url || '?n' END AS url, nullif(platform, '') AS platform FROM career_urls) GROUP BY site_id, url)
SELECT coalesce(o.site_id, n.site_id) AS site_id, coalesce(o.url, n.url) AS url, coalesce(o.id, n.id) AS id,
  CASE WHEN n.url IS NULL THEN o.platform ELSE coalesce(n.platform, o.platform) END AS platform, CASE WHEN n.url IS NULL THEN is_active ELSE true END AS is_active,
  CASE WHEN n.url IS NULL THEN fail_count ELSE 0 END AS fail_count, coalesce(suspicious_count, 0) AS suspicious_count FROM o FULL JOIN n ON o.site_id = n.site_id AND o.url = n.url""", "career_urls")(_upsert_urls)  # fmt: skip
query("u7_u8_cache_purge", (
    "SELECT namespace, count(*) FILTER (created_at + ttl_seconds >= 4000) AS kept, count(*) FILTER (created_at + ttl_seconds < 4000) AS purged "
    "FROM cache WHERE namespace <> 'url' GROUP BY 1"
), "cache")(
    lambda df: df.where("namespace <> 'url'").withColumn("gone", state.is_purged(F.col("created_at"), F.col("ttl_seconds"), F.lit(4000))).groupBy("namespace").agg(F.count_if(~F.col("gone")).alias("kept"), F.count_if("gone").alias("purged"))
)
_fresh = lambda df: df.select(F.concat(F.lit("k"), F.col("id") * 2).alias("key"), F.lit("other").alias("namespace"), F.upper("value").alias("value"), F.lit("m").alias("model"), (F.col("ttl_seconds") + 1).alias("ttl_seconds"), (F.col("tokens_saved") + 2).alias("tokens_saved"))
_entries = lambda df: df.select("key", "namespace", "value", "model", "ttl_seconds", "created_at", "hit_count", "tokens_saved")
query("u5_cache_upsert", f""", n AS (SELECT 'k' || id * 2 AS key, 'other' AS namespace, upper(value) AS value, 'm' AS model, ttl_seconds + 1 AS ttl_seconds, tokens_saved + 2 AS tokens_saved FROM cache)
SELECT coalesce(c.key, n.key) AS key, coalesce(c.namespace, n.namespace) AS namespace, coalesce(n.value, c.value) AS value, CASE WHEN c.key IS NULL THEN n.model ELSE c.model END AS model, coalesce(n.ttl_seconds, c.ttl_seconds) AS ttl_seconds,
  CASE WHEN n.key IS NULL THEN c.created_at ELSE {_NOW} END::BIGINT AS created_at, CASE WHEN n.key IS NULL THEN c.hit_count ELSE 0 END AS hit_count, coalesce(n.tokens_saved, c.tokens_saved) AS tokens_saved FROM cache c FULL JOIN n ON n.key = c.key""", "cache")(
    lambda df: state.cache_set(_entries(df), _fresh(df), _now())
)
_probes = lambda p: p.select(F.concat(F.lit("k"), F.pmod(F.col("id"), F.lit(3001))).alias("key"))
query("j9_cache_answers", (
    "SELECT p.key, count(*) AS asked, count(c.key) AS hits, any_value(c.value) AS value FROM (SELECT 'k' || id % 3001 AS key "
    "FROM calls) p LEFT JOIN (SELECT * FROM cache WHERE created_at + ttl_seconds > 4000) c ON c.key = p.key "
    "GROUP BY 1"
), "cache", "calls")(
    lambda c, p: state.cache_read(c, _probes(p), F.lit(4000))[0].groupBy("key").agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits"), F.any_value("value").alias("value"))
)
query("e7_cache_after_reads", (
    "SELECT c.key, (hit_count + CASE WHEN created_at + ttl_seconds > 4000 THEN coalesce(n, 0) ELSE 0 END)::INT AS hit_count "
    "FROM cache c LEFT JOIN (SELECT 'k' || id % 3001 AS key, count(*) AS n FROM calls GROUP BY 1) p ON p.key = c.key"
), "cache", "calls")(
    lambda c, p: state.cache_read(c, _probes(p), F.lit(4000))[1].select("key", "hit_count")
)

# --- reports ------------------------------------------------------------------------

query("a3_j2_dashboard", """SELECT s.id AS site_id, s.domain, s.last_scanned_at, count(DISTINCT CASE WHEN j.is_active THEN j.id END) AS active_jobs, count(DISTINCT j.id) AS total_jobs, count(DISTINCT u.id) AS n_urls,
  count(DISTINCT j.id) - count(DISTINCT CASE WHEN j.is_active THEN j.id END) AS removed_jobs
  FROM sites s LEFT JOIN jobs j ON j.site_id = s.id LEFT JOIN career_urls u ON u.site_id = s.id AND u.is_active GROUP BY s.id, s.domain, s.last_scanned_at""", "sites", "jobs", "career_urls")(reports.dashboard)  # fmt: skip
query("j1_t1_latest_history", (
    "SELECT h.id, event, changed_on, title, domain FROM history h JOIN jobs j ON j.id = h.job_id "
    "JOIN sites s ON s.id = j.site_id ORDER BY changed_on DESC, h.id DESC LIMIT 100"
), "history", "jobs", "sites")(lambda h, j, s: reports.latest_history(h, j, s, 100))
query("sc2_t1_site_history", (
    "SELECT h.id, event, changed_on, title, domain FROM history h JOIN jobs j ON j.id = h.job_id "
    "JOIN sites s ON s.id = j.site_id WHERE domain = 'supplier-000000003.example.com' ORDER BY changed_on DESC, h.id DESC LIMIT 50"
), "history", "jobs", "sites")(
    lambda h, j, s: reports.latest_history(h, j, s, 50, "supplier-000000003.example.com")
)
query("t2_sites_by_scan", "SELECT id, domain, row_number() OVER (ORDER BY last_scanned_at DESC NULLS LAST, id) AS n FROM sites ORDER BY n LIMIT 20", "sites")(
    lambda df: df.orderBy(F.desc_nulls_last("last_scanned_at"), "id").limit(20).select("id", "domain", F.expr("cast(row_number() over (order by last_scanned_at desc nulls last, id) as long)").alias("n"))
)
query("t3_sc3_urls_by_success", "SELECT site_id, id, url, row_number() OVER (PARTITION BY site_id ORDER BY last_success_at DESC NULLS LAST, id) AS n FROM career_urls WHERE is_active", "career_urls")(
    lambda df: df.where("is_active").select("site_id", "id", "url", F.expr("cast(row_number() over (partition by site_id order by last_success_at desc nulls last, id) as long)").alias("n"))
)
_rank = urls.careers_rank_sql("url")
query("t4_best_careers_url", f"SELECT site_id, arg_min(url, ({', '.join(_rank)}, id)) AS best_url FROM career_urls GROUP BY 1", "career_urls")(lambda df: reports.best_careers_url(df, urls.careers_rank(F.col("url"))))
query("a4_a5_cache_stats", (
    "SELECT namespace, count(*) AS entries, sum(hit_count)::BIGINT AS hits, sum(tokens_saved * hit_count)::BIGINT AS tokens_saved, round(coalesce(sum(hit_count) "
    "/ nullif(sum(hit_count) + count(*), 0), 0), 6) AS hit_rate, round(sum(tokens_saved * hit_count) * 0.00001::DOUBLE, 6) AS saved_usd "
    "FROM cache GROUP BY 1"
), "cache")(reports.cache_stats)
_price = lambda k: "CASE model " + " ".join(f"WHEN {quote(m)} THEN {p[k]}::DOUBLE" for m, p in reports.PRICES.items()) + f" ELSE {reports.DEFAULT_PRICE[k]}::DOUBLE END"
query("a7_a8_usage", (
    f"SELECT model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(CASE WHEN "
    f"reported_usd > 0 THEN reported_usd ELSE prompt_tokens / 1e6 * {_price(0)} + completion_tokens / 1e6 * {_price(1)} END), 4) AS usd, round(sum(seconds), "
    f"4) AS seconds FROM calls GROUP BY 1"
), "calls")(reports.usage)
query("a10_job_markers", f"SELECT id, ({' + '.join(f'contains(lower(title), {quote(m)})::INT' for m in markup.MARKERS)})::BIGINT AS markers FROM postings", "postings")(
    lambda df: df.select("id", markup.markers(F.col("title")).alias("markers"))
)
query("a12_t6_longest_title", "SELECT site_id, arg_max(title, (length(title), -id)) AS longest FROM postings GROUP BY 1", "postings")(lambda df: df.groupBy("site_id").agg(F.max_by("title", F.struct(F.length("title"), -F.col("id"))).alias("longest")))
query("w6_date_breaks", "SELECT id, changed_on, changed_on IS DISTINCT FROM lag(changed_on) OVER (PARTITION BY id % 100 ORDER BY changed_on DESC, id DESC) AS new_day FROM history", "history")(
    lambda df: df.select("id", "changed_on", F.expr("not (changed_on <=> lag(changed_on) over (partition by id % 100 order by changed_on desc, id desc))").alias("new_day"))
)
_PAY3 = ("(id % 4 * 1500)", "(id % 3 * 2500000)", "(CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE 'EUR' END)")
query("sk3_terminal_rows", (
    f"SELECT company, title, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE title END, '—') AS title_en, location, {text.salary_display_sql(*_PAY3)} AS salary, "
    f"'website:' || site_id AS source FROM postings"
), "postings")(
    lambda df: reports.terminal_rows(
        df.select(
            "company", "title", F.expr("case when id % 3 <> 0 then title end").alias("title_en"), "location",
            *[p.alias(n) for p, n in zip(_pay(), ("salary_from", "salary_to", "salary_currency"), strict=True)], F.concat(F.lit("website:"), "site_id").alias("source"),
        )
    )
)
_secs = "(id * 7 % 9000)"
query("sk4_elapsed", (
    f"SELECT id, CASE WHEN {_secs} < 60 THEN printf('%.2f сек', {_secs}::DOUBLE) WHEN {_secs} < 3600 THEN printf('%d мин %.1f сек', ({_secs} // 60)::INT, ({_secs} "
    f"% 60)::DOUBLE) ELSE printf('%d ч %d мин %.0f сек', ({_secs} // 3600)::INT, ({_secs} % 3600 // 60)::INT, ({_secs} % 60)::DOUBLE) END AS elapsed "
    f"FROM fetches"
), "fetches")(
    lambda df: df.select("id", reports.elapsed(F.expr("cast(id * 7 % 9000 as double)")).alias("elapsed"))
)
query("e1_w7_breaker", """SELECT domain, count(*) FILTER (status >= 400 AND id > last) AS fail_count, count(*) FILTER (status >= 400 AND id > last) < 3 AS is_active, count(*) FILTER (status >= 400) AS n_failed
  FROM (SELECT *, coalesce(max(CASE WHEN status < 400 THEN id END) OVER (PARTITION BY domain), -1) AS last FROM fetches) GROUP BY 1""", "fetches")(lambda df: state.breaker(df))  # fmt: skip
#: Waits as headers give them: seconds, junk, and dates before and after the fetch, which is at noon.
_WAIT = "CASE WHEN id % 11 < 3 THEN concat('Wed, ', {date}, ' GMT') ELSE retry_after END"
_WAIT_SPARK = _WAIT.format(date="date_format(timestampadd(second, cast(id % 45 as int) - 10, cast(fetched_on as timestamp)), 'dd MMM yyyy HH:mm:ss')")
_WAIT_DUCK = _WAIT.format(date="strftime(fetched_on::TIMESTAMP + to_seconds((id % 45 - 10)::INT), '%d %b %Y %H:%M:%S')")


def _e4_sql(said: str, at: str) -> str:
    return f"""SELECT domain, round(list_reduce(list({{'w': w, 'k': k, 'd': 0::DOUBLE}} ORDER BY id), lambda a, x: {{'w': 0::DOUBLE, 'k': 0, 'd':
  CASE WHEN x.k = 1 THEN least(coalesce(x.w, a.d * 2), 30) WHEN a.d > 0.5 THEN CASE WHEN a.d * 0.9 <= 1.1 * 0.5 THEN 0.5 ELSE a.d * 0.9 END ELSE a.d END::DOUBLE}}, {{'w': 0::DOUBLE, 'k': 0, 'd': 0.5::DOUBLE}}).d, 6) AS delay, count(*) AS n_events
  FROM (SELECT domain, id, CASE WHEN status IN (429, 503) THEN 1 ELSE 0 END AS k,
    nullif(CASE WHEN regexp_matches(said, '^\\d+$') THEN said::DOUBLE ELSE greatest(epoch(try_strptime(said, 'Wed, %d %b %Y %H:%M:%S GMT')) - {at}, 0) END, 0) AS w
    FROM (SELECT *, {said} AS said FROM fetches) WHERE status IN (429, 503) OR status BETWEEN 200 AND 399) GROUP BY 1"""


_E4_SQL = _e4_sql(_WAIT_DUCK, "epoch(fetched_on::TIMESTAMP)")
_limits = lambda df: state.delays(df.withColumns({"retry_after": F.expr(_WAIT_SPARK), "at": F.col("fetched_on").cast("timestamp")}))
query("e4_rate_limit", _E4_SQL, "fetches")(_limits)
query("a11_rate_limit_stats", f", e AS ({_E4_SQL}) SELECT count(*) AS domains, count(*) FILTER (delay > 0.5) AS slowed, max(delay) AS longest FROM e", "fetches")(lambda df: state.rate_limit_stats(_limits(df)))


scalar("f7_f8_f10_f11_f15_links", "postings", {
    "softgarden_menu": (lambda: urls.is_softgarden_menu(F.col("url")), urls.is_softgarden_menu_sql("url")),
    "join_menu": (lambda: urls.is_join_menu(F.col("url")), urls.is_join_menu_sql("url")),
    "listing": (lambda: urls.on_listing(F.col("url")), urls.on_listing_sql("url")),
    "single": (lambda: urls.is_single_posting(F.col("url")), urls.is_single_posting_sql("url")),
    "external": (lambda: urls.is_external_board(F.col("url")), urls.is_external_board_sql("url")),
})
scalar("f21_f22_redirects", "career_urls", {"redirected": (lambda: urls.is_redirect(F.col("url"), F.concat(F.lit("https://WWW."), F.expr("case when id % 2 = 0 then 'site1.example.com/x' else 'other.org' end"))), urls.is_redirect_sql("url", "('https://WWW.' || CASE WHEN id % 2 = 0 THEN 'site1.example.com/x' ELSE 'other.org' END)"))})
_error = "(CASE WHEN status = 429 THEN 'Rate limit hit' WHEN status = 500 THEN 'HTTP 500' WHEN status = 404 THEN 'not found' ELSE '...' END)"
scalar("f19_f24_answers", "fetches", {"transient": (lambda: text.is_transient(F.expr(_error)), text.is_transient_sql(_error)), "spoilt": (lambda: text.bad_translation(F.expr(_error)), text.bad_translation_sql(_error))})
scalar("v12_v13_v14_v18_parts", "postings", {
    "plain": (lambda: text.without_badge(F.concat(F.col("title"), F.lit(" New"))), text.without_badge_sql("(title || ' New')")),
    "head": (lambda: text.split_title(F.concat(F.trim("title"), F.lit(" | Berlin")))["title"], text.split_title_sql("(trim(title) || ' | Berlin')")[0]),
    "place": (lambda: text.split_title(F.concat(F.trim("title"), F.lit(" | Berlin")))["location"], text.split_title_sql("(trim(title) || ' | Berlin')")[1]),
    "unit": (lambda: text.first_part(F.concat(F.col("department"), F.lit(" - Vollzeit"))), text.first_part_sql("(department || ' - Vollzeit')")),
})
_said = "(CASE WHEN id % 3 = 0 THEN 'see https://a.b/c?x=1, ok' WHEN id % 3 = 1 THEN 'path \"/jobs/x\" here' ELSE 'none' END)"
scalar("v26_quoted_url", "postings", {"found": (lambda: text.quoted_url(F.expr(_said), F.lit("https://base/")), text.quoted_url_sql(_said, "'https://base/'"))})
_answer = """(CASE id % 9 WHEN 0 THEN concat('Sure: {"jobs": [{"t": "', trim(title), '"}]} done') WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'nothing {bad' WHEN 3 THEN concat('x {"jobs": [', id, ']} and {bad}')
  WHEN 4 THEN concat('```json ', '{"a": {"b": ', id, '}}', ' ``` tail {}') WHEN 5 THEN concat('see {oops} then [', id, ', 7] end') WHEN 6 THEN '```json {broken ``` {"jobs": [1]}' WHEN 7 THEN concat('{"c": 1} { "jobs": [', id, ']}') ELSE '' END)"""
scalar("v27_answer_json", "postings", {"json": (lambda: text.answer_json(F.expr(_answer)), text.answer_json_sql(_answer))})
scalar("l10_search_urls", "postings", {
    "de": (lambda: urls.search_url("https://www.stepstone.de/jobs/", text.slug(F.col("title")), text.location_slug(F.coalesce("location", F.lit("Berlin")), text.CITIES_DE), F.col("page_no") - 1), urls.search_url_sql("https://www.stepstone.de/jobs/", text.slug_sql("title"), text.location_slug_sql("coalesce(location, 'Berlin')", text.CITIES_DE), "(page_no - 1)")),
    "at": (lambda: urls.search_url("https://www.karriere.at/jobs/", text.slug(F.col("title")), None, F.col("page_no") - 1), urls.search_url_sql("https://www.karriere.at/jobs/", text.slug_sql("title"), None, "(page_no - 1)")),
})
_words17 = " OR ".join(f"contains(lower(url), '{w}')" for w in urls.SITEMAP_WORDS)
query("f17_t7_sitemap_candidates", (
    f"SELECT id, page FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM (SELECT *, bool_or(m) "
    f"OVER (PARTITION BY page) AS any_match FROM (SELECT id, nullif(site_id % 20, 3) AS page, coalesce({_words17}, false) AND site_id % 20 < 15 AS m "
    f"FROM postings)) WHERE m OR NOT any_match) WHERE n <= CASE WHEN any_match THEN 50 ELSE 100 END"
), "postings")(
    lambda df: postings.sitemap_candidates(
        df.withColumn("page", F.expr("nullif(site_id % 20, 3)")), F.exists(F.array(*map(F.lit, urls.SITEMAP_WORDS)), lambda w: F.contains(F.lower("url"), w)) & (F.col("site_id") % 20 < 15), ["page"], [F.col("id")]
    ).select("id", "page")
)
_PLACE18 = {"0": "Moscow", "1": "spb", "2": "Russia", "3": "Paris"}
query("f18_search_parameters", (
    "SELECT id, coalesce(CASE lower(place) WHEN 'moscow' THEN '1' WHEN 'spb' THEN '2' WHEN 'russia' THEN '113' END, suggested) AS area, CASE id % 2 WHEN 0 THEN "
    "'between1And3' ELSE 'moreThan6' END AS experience, salary, CASE WHEN salary IS NOT NULL THEN true END AS only_with_salary "
    "FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'Moscow' WHEN 1 THEN 'spb' WHEN 2 THEN 'Russia' ELSE 'Paris' END AS place, CASE WHEN id % 8 = 3 THEN 's' || id "
    "END AS suggested, CASE WHEN id % 3 = 0 THEN id END AS salary FROM calls)"
), "calls")(
    lambda df: df.select("id", F.expr("case id % 4 when 0 then 'Moscow' when 1 then 'spb' when 2 then 'Russia' else 'Paris' end").alias("place"), F.expr("case id % 2 when 0 then '1-3' else '6+' end").alias("years"), F.expr("case when id % 8 = 3 then concat('s', id) end").alias("suggested"), F.expr("case when id % 3 = 0 then id end").alias("salary"))
    .select("id", *reports.search_parameters(F.col("place"), F.col("suggested"), F.col("years"), F.col("salary")))
)
query("f20_batches_in_english", f"SELECT site_id, page_no, bool_and({text.looks_english_sql('title')}) AS english FROM postings GROUP BY ALL", "postings")(lambda df: df.groupBy("site_id", "page_no").agg(F.bool_and(text.looks_english(F.col("title"))).alias("english")))
query("e6_concurrency", (
    "SELECT domain, max(open)::BIGINT AS most_open FROM (SELECT domain, sum(d) OVER (PARTITION BY domain "
    "ORDER BY t, d) AS open FROM (SELECT domain, id AS t, 1 AS d FROM fetches UNION ALL SELECT domain, id + 100 + status, -1 "
    "FROM fetches)) GROUP BY 1"
), "fetches")(
    lambda df: state.most_open(df.select("domain", F.col("id").alias("started"), (F.col("id") + 100 + F.col("status")).alias("ended")), "domain")
)
query("e7_cache_hits", (
    "SELECT namespace, count(*) FILTER (live) AS hits, count(*) FILTER (NOT live) AS misses, round(count(*) FILTER (live) / count(*), 6) AS hit_rate "
    "FROM (SELECT namespace, created_at + ttl_seconds > 4000 AS live FROM cache) GROUP BY 1"
), "cache")(
    lambda df: df.withColumn("live", state.is_live(F.col("created_at"), F.col("ttl_seconds"), F.lit(4000))).groupBy("namespace").agg(F.count_if("live").alias("hits"), F.count_if(~F.col("live")).alias("misses"), F.round(F.count_if("live") / F.count("*"), 6).alias("hit_rate"))
)
query("u3_get_or_create_site", (
    ", n AS (SELECT DISTINCT 's' || id % 50 || '.example.com' AS domain FROM postings UNION SELECT domain "
    "FROM sites) SELECT n.domain, s.id IS NULL AS created FROM n LEFT JOIN sites s ON s.domain = n.domain"
), "sites", "postings")(
    lambda s, p: p.select(F.concat(F.lit("s"), F.col("id") % 50, F.lit(".example.com")).alias("domain")).union(s.select("domain")).distinct().join(s.select("domain", "id"), "domain", "left").select("domain", F.col("id").isNull().alias("created"))
)
_SITE_URL = "concat('https://www.site-', cast(site_id as string), '.com/x')"
query("x29_j6_records", (
    f"SELECT id, 'web-' || host || '-' || (row_number() OVER (PARTITION BY nullif(site_id, 7) ORDER BY nullif(pos % 50, 3) NULLS FIRST, id) - 1) AS external_id, "
    f"title, {text.company_name_sql('host')} AS company, coalesce(location, 'Unknown') AS location, coalesce(url, 'https://careers') AS url, 'website:' || host "
    f"AS source, CASE WHEN id % 4 <> 0 THEN lower(title) END AS title_en FROM (SELECT *, 'www.site-' || site_id || '.com' AS host "
    f"FROM postings)"
), "postings")(
    lambda df: postings.records(
        df.withColumns({"title_en": F.when(F.col("id") % 4 != 0, F.lower("title")), "pos": F.expr("nullif(pos % 50, 3)"), "site": F.expr("nullif(site_id, 7)")}),
        F.expr(_SITE_URL), F.lit("https://careers"), ["pos", "id"], ["site"], keep=["id"],
    ).drop("site")
)
query(
    "w4_running_heading",
    "SELECT id, last_value(CASE WHEN department <> '' THEN department END IGNORE NULLS) OVER (PARTITION BY nullif(site_id, 7) ORDER BY id) AS heading FROM postings",
    "postings",
)(
    lambda df: postings.with_running_heading(
        df.withColumns({"h": F.nullif("department", F.lit("")), "site": F.expr("nullif(site_id, 7)")}), ["site"], "id", "h", "heading", 100_000_000
    ).select("id", "heading")
)
#: Answers for each site: an empty one for every third, and beside every second of those a good one.
_told = lambda df: df.select("domain", F.expr("case when id % 3 = 0 then '' else concat('about ', domain) end").alias("description")).union(
    df.where("id % 6 = 0").select("domain", F.concat(F.lit("more "), "domain"))
)
_TOLD = "CASE WHEN id % 3 <> 0 THEN 'about ' || domain WHEN id % 6 = 0 THEN 'more ' || domain ELSE description END"
query("p1_company_info", f"SELECT id, domain, CASE WHEN coalesce(description, '') = '' THEN {_TOLD} ELSE description END AS description FROM sites", "sites")(
    lambda df: enrich.company_info(df, _told(df)).select("id", "domain", "description")
)
query("p2_company_info_of_pages", (
    f"SELECT domain, name, CASE WHEN coalesce(description, '') <> '' THEN description ELSE {_TOLD} END AS description "
    f"FROM sites UNION ALL SELECT 'new-' || id, 'new-' || id, 'fresh' FROM sites"
), "sites")(
    lambda df: enrich.company_info_of_pages(df, _told(df).union(df.select(F.concat(F.lit("new-"), "id"), F.lit("fresh"))), F.xxhash64("new.domain")).select("domain", "name", "description")
)
query("p10_tracked_usage", (
    "SELECT model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(CASE WHEN id % 3 = 2 THEN 0 ELSE completion_tokens END)::BIGINT AS completion_tokens, "
    "round(sum(CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 0.25 ELSE prompt_tokens / 1e6 * 0.5 + CASE WHEN id % 3 = 2 THEN 0 ELSE completion_tokens END / 1e6 * "
    "1.5 END), 4) AS usd, round(sum(seconds), 4) AS seconds FROM (SELECT *  REPLACE ('m' || id % 3 AS model) "
    "FROM calls) GROUP BY 1"
), "calls")(
    lambda df: reports.usage(reports.tracked(df.select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), "seconds", F.expr(_BODY10).alias("body"))))
)
_BODY10 = """case id % 3 when 0 then concat('{"usage":{"prompt_tokens":', prompt_tokens, ',"completion_tokens":', completion_tokens, if(id % 5 = 0, ',"cost":0.25', ''), '}}')
  when 1 then concat('{"prompt_eval_count":', prompt_tokens, ',"eval_count":', completion_tokens, '}') else concat('{"prompt_eval_count":', prompt_tokens, '}') end"""
query("v28_v30_report_times", f"SELECT id, {text.parsed_time_sql('changed_at')} AS stamp, {text.report_day_sql('changed_at')} AS day, {text.report_clock_sql('changed_at')} AS clock FROM history", "history")(
    lambda df: df.select("id", text.parsed_time(F.col("changed_at")).alias("stamp"), text.report_day(F.col("changed_at")).alias("day"), text.report_clock(F.col("changed_at")).alias("clock"))
)
_ACTION = "CASE event WHEN 'added' THEN 'добавлена' WHEN 'removed' THEN 'закрыта' WHEN 'reactivated' THEN 'вернулась' ELSE event END"
query("sk5_history_report", (
    f"SELECT line, CASE WHEN day IS DISTINCT FROM lag(day) OVER (ORDER BY line) THEN day END AS heading, clock, said "
    f"FROM (SELECT row_number() OVER (ORDER BY changed_at DESC NULLS LAST, h.id DESC)::INT AS line, {text.report_day_sql('changed_at')} AS day, {text.report_clock_sql('changed_at')} "
    f"AS clock, title || CASE WHEN coalesce(location, '') <> '' THEN ' (' || location || ')' ELSE '' END || ' [' || domain || '] — ' || {_ACTION} AS said "
    f"FROM history h JOIN jobs j ON j.id = h.job_id JOIN sites s ON s.id = j.site_id) WHERE line <= 300"
), "history", "jobs", "sites")(lambda h, j, s: reports.history_report(h, j, s, 300))
_HOST7 = "(CASE id % 4 WHEN 0 THEN 'www.acme.co.uk' WHEN 1 THEN domain WHEN 2 THEN '10.0.0.' || id ELSE 'localhost' END)"
scalar("l7_registrable_domain", "sites", {"registered": (lambda: urls.registrable_domain(F.expr(_HOST7)), urls.registrable_domain_sql(_HOST7))})
query("u6_touched_sites", f"SELECT id, domain, CASE WHEN id % 3 = 0 THEN {_NOW} ELSE last_scanned_at END::BIGINT AS last_scanned_at FROM sites", "sites")(
    lambda df: state.touched(df, df.where("id % 3 = 0"), "id", {"last_scanned_at": _now()}).select("id", "domain", "last_scanned_at")
)
query("w5_repeated_lines", (
    "SELECT id, title FROM (SELECT id, title, lag(trim(title)) OVER w IS NOT DISTINCT FROM trim(title) AND row_number() "
    "OVER w > 1 AS same FROM (SELECT id, site_id, page_no, department AS title FROM postings) WINDOW w AS (PARTITION BY site_id, page_no "
    "ORDER BY id)) WHERE NOT same"
), "postings")(
    lambda df: markup.without_repeats(df.select("id", "site_id", "page_no", F.col("department").alias("title")), ["site_id", "page_no"], "id", "title").select("id", "title")
)
query("sc4_active_jobs", "SELECT id, site_id, title, location, url FROM jobs WHERE is_active AND site_id = 7", "jobs")(lambda df: reports.active_jobs(df, 7).select("id", "site_id", "title", "location", "url"))
query("f6_v23_title_signals", "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in text.title_signals_sql("title").items()) + (
    f", {text.confidence_sql('method', {k: v for k, v in text.title_signals_sql('title').items() if k in text.SIGNALS})} AS confidence "
    f"FROM postings"
), "postings")(
    lambda df: df.withColumn("s", text.title_signals(F.col("title"))).select("id", "s.*", text.confidence(F.col("method"), {k: F.col(f"s.{k}") for k in text.title_signals_sql("title") if k in text.SIGNALS}).alias("confidence"))
)
_nav = "('https://x/' || CASE WHEN id % 3 = 0 THEN 'en/jobs' WHEN id % 3 = 1 THEN 'about' ELSE 'a/b/c' END)"
scalar("t5_sitemap_or_nav", "career_urls", {"chosen": (lambda: urls.chosen_careers_url(F.col("url"), F.expr(_nav)), urls.chosen_careers_url_sql("url", _nav))})


# --- pages --------------------------------------------------------------------------

from . import boards, landed  # noqa: E402
from .boards import pages as _pages  # noqa: E402


def _register(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


for _name, _f in boards.QUERIES.items():
    _register(_name, _f, boards.SQL.get(_name))
_landed_sql = landed.sql(_e4_sql("retry_after", "NULL"))
for _name, _f in landed.QUERIES.items():
    _register(_name, _f, _landed_sql[_name])
_register("x23_clean_html", lambda spark, d: _pages(spark, d).select("page_id", markup.clean_html(F.col("html")).alias("clean")))
_register("x24_markdown", lambda spark, d: _pages(spark, d).select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown")))
_register("x22_job_section", lambda spark, d: _pages(spark, d).select("page_id", markup.find_job_section(F.col("html")).alias("section")))
_register(
    "stream_crawl_health",
    lambda spark, d: _health(spark, d),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS domain, CASE WHEN value >= 50 THEN 'server_error' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY ALL",
)


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.crawl import health

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("domain"), F.when(F.col("value") >= 50, 500).otherwise(200).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return health(rows, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "domain", "outcome", "n")


query("e5_spacing", """SELECT domain, id, start FROM (SELECT domain, id, max(asked - n * 3) OVER (PARTITION BY domain ORDER BY id) + n * 3 AS start FROM (SELECT domain, id, (id % 100 * 10)::DOUBLE AS asked, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM fetches))""", "fetches")(
    lambda df: state.spaced(df.select("domain", "id", (F.col("id") % 100 * 10).alias("asked"), F.lit(3.0).alias("delay")))
)

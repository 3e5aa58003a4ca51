"""Queries over what crawls land: search answers, crawls of several pages,
answers of models, parsers in SQL, exports and streams.

All of it is made from the stored tables, and the SQL says what must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rewrite import quote
from ..operators import enrich, extract, markup, models, phrases, postings, reports
from ..operators.udtf import Registry
from ..sources import json_export, searchers
from ..sources.sinks import shared_folder
from ..streaming import stateful
from .boards import BOARDS, ITEM, ITEMS, board_pages, board_sql, cards, pages
from .catalog import relation, with_relations
from .write_path import postings_of_pages

_ITEMS = f"regexp_extract_all(html, {quote(ITEM)}, 1)"


def _own(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


# --- X5-X14b by SQL ------------------------------------------------------------------

_PLATFORMS = [n for n, b in BOARDS.items() if b["platform"] not in (None, "stepstone", "karriere")]
_LATERAL = """SELECT p.page_id, p.platform, t.pos, t.title, t.location, t.url, t.department, t.company
FROM {pages} p, LATERAL parse_postings(p.html, p.url, p.platform) t"""


def _lateral(spark: SparkSession, d: str) -> DataFrame:
    every = None
    for name in _PLATFORMS:
        one = board_pages(spark, d, name)
        every = one if every is None else every.unionByName(one)
    Registry().register(spark)
    return spark.sql(_LATERAL, pages=every).where(~text.is_open_application(F.col("title")))


_LATERAL_SQL = " UNION ALL ".join(f"SELECT page_id, '{BOARDS[n]['platform']}' AS platform, pos::INT AS pos, title, location, url, department, company FROM ({board_sql(n)})" for n in _PLATFORMS)

# --- SC9, SC10: landed answers of searches ----------------------------------------------


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """Each page's answer is landed with a keyword and a page number of its own, in tables, and read back."""
    searchers.register(spark)
    out = None
    for name in ("x15_stepstone", "x16_karriere"):
        site, folder = BOARDS[name]["platform"], _own(spark, name)
        rows = board_pages(spark, d, name).select(F.concat(F.lit("k"), F.floor(F.col("page_id") / 3).cast("string")).alias("keyword"), (F.col("page_id") % 3).cast("int").alias("page"), "html")
        rows.write.option("maxRecordsPerFile", 2000).parquet(folder)
        read = spark.read.format(site).option("numPartitions", spark.conf.get("spark.sql.shuffle.partitions")).load(folder)
        out = read if out is None else out.unionByName(read)
    return out.select("keyword", "page", "pos", "title", "company", "location", "url", "source")


_SEARCHES_SQL = f"""SELECT 'k' || page_id // 3 AS keyword, (page_id % 3)::INT AS page, k::INT AS pos, 'Developer ' || t AS title, 'Acme ' || k AS company, 'Germany' AS location,
  'https://www.stepstone.de/x--' || k AS url, 'stepstone.de' AS source FROM {ITEMS}
UNION ALL SELECT 'k' || page_id // 3, (page_id % 3)::INT, k::INT, 'Software Developer ' || t, 'Unknown', 'Austria', 'https://www.karriere.at/jobs/' || k, 'karriere.at' FROM {ITEMS}"""

# --- E8: next-page links -------------------------------------------------------------------

_NEXT = """CASE WHEN page_id % 11 = 0 THEN concat('https://p/', page_id) WHEN page_id % 7 = 0 THEN concat('https://gone/', page_id)
  WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 13 = 0 THEN concat('https://p/', page_id - 1) ELSE concat('https://p/', page_id + 1) END"""


def _crawls(spark: SparkSession, d: str) -> DataFrame:
    """Every page starts a crawl: links go on, end, loop back, point to themselves or to what isn't there."""
    rows = pages(spark, d).select("page_id", F.concat(F.lit("https://p/"), "page_id").alias("url"), F.expr(_NEXT).alias("next_page_url"))
    return postings.followed_pages(rows.select(F.col("page_id").alias("site_id"), "url"), rows.select("url", "next_page_url"))


_CRAWLS_SQL = f"""WITH RECURSIVE p AS (SELECT page_id, 'https://p/' || page_id AS url, {_NEXT} AS next FROM pages),
c AS (SELECT page_id AS site_id, 1 AS page_no, url, next FROM p UNION ALL SELECT c.site_id, page_no + 1, p.url, p.next FROM c JOIN p ON p.url = c.next WHERE page_no < 3)
SELECT site_id, page_no::INT AS page_no, url FROM c"""

# --- J6, F19: titles and their translations ---------------------------------------------------

_SAID = f"transform(filter({_ITEMS}, (t, k) -> k < size({_ITEMS}) - page_id % 3), t -> concat('The ', t, if(t like '%e', ' Error', '')))"


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.expr(_ITEMS).alias("titles"), F.expr(_SAID).alias("translations"))


_SAID_SQL = f"SELECT page_id, t AS title, k AS pos, CASE WHEN k < (count(*) OVER (PARTITION BY page_id)) - page_id % 3 THEN 'The ' || t || CASE WHEN t LIKE '%e' THEN ' Error' ELSE '' END END AS title_en FROM {ITEMS}"


def _good(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("page_id", text.good_translations(F.col("titles"), F.col("translations")).alias("good"))


# --- X26, X27, X28: where a page's postings come from -----------------------------------------

_LEVER = "x6_x25_lever"


def _answers(spark: SparkSession, d: str, where: str, method: str, title: str) -> DataFrame:
    """Postings that someone else found: one for each item of the pages that are named."""
    rows = pages(spark, d).where(where).select("page_id", F.posexplode(F.expr(_ITEMS)).alias("k", "t"))
    return rows.select(
        "page_id", F.col("k").cast("long").alias("pos"), F.lit(method).alias("method"), F.concat(F.lit(title), "t").alias("title"), F.lit("Linz").alias("location"),
        F.concat(F.lit("https://x/"), "t", F.lit("-"), "k").alias("url"), F.lit(None).cast("string").alias("department"), F.lit(None).cast("string").alias("company"),
    )


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    found = extract.extracted(board_pages(spark, d, _LEVER).where("page_id % 3 = 0"))
    said = _answers(spark, d, "page_id % 2 = 0", "llm", "DEVELOPER ")
    files = _answers(spark, d, "page_id % 4 <> 1", "pdf_link", "Developer ").unionByName(_answers(spark, d, "page_id % 5 = 0", "pdf_link", "Clerk "))
    return extract.cascade(found, said, files).select("page_id", "method", "title", "confidence")


_CASCADE_SQL = f"""WITH i AS (SELECT * FROM {ITEMS}),
f AS (SELECT page_id, 'job_board:lever' AS method, 0 AS r, k, 'Developer ' || t AS title FROM i WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 'llm', 2, k, 'DEVELOPER ' || t FROM i WHERE page_id % 2 = 0 AND page_id % 3 <> 0
  UNION ALL SELECT page_id, 'pdf_link', 3, k, 'Developer ' || t FROM i WHERE page_id % 4 <> 1 AND page_id % 3 <> 0
  UNION ALL SELECT page_id, 'pdf_link', 3, k, 'Clerk ' || t FROM i WHERE page_id % 5 = 0 AND page_id % 3 <> 0)
SELECT page_id, method, title, CASE r WHEN 0 THEN 1.0 WHEN 2 THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY page_id, {text.candidate_title_sql("title")} ORDER BY r, k) = 1"""


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every third page has cards; the others' postings are those of an answer."""
    b = BOARDS[_LEVER]
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.expr(cards(b["card"])), "html")).otherwise(F.col("html"))
    rows = pages(spark, d).select("page_id", F.col("page_id").alias("site_id"), F.lit(1).alias("page_no"), F.lit(b["url"]).alias("url"), html.alias("html"), F.lit("lever").alias("platform"))
    found = postings_of_pages(rows, _answers(spark, d, "page_id >= 0", "llm", "Developer "))
    return found.select("site_id", "method", "title", "location", "url")


_FALLBACK_SQL = f"""WITH i AS (SELECT page_id, t, k, page_id % 3 = 0 AS own FROM {ITEMS} QUALIFY row_number() OVER (PARTITION BY page_id, {text.candidate_title_sql("('Developer ' || t)")} ORDER BY k) = 1)
SELECT page_id AS site_id, CASE WHEN own THEN 'job_board:lever' ELSE 'llm' END AS method, 'Developer ' || t AS title, CASE WHEN own THEN 'Wien ' || k ELSE 'Linz' END AS location,
  CASE WHEN own THEN 'https://jobs.lever.co/acme/' || k ELSE 'https://x/' || t || '-' || k END AS url FROM i"""

# --- SK1: the JSON array ----------------------------------------------------------------------

_PAY = ("(id % 4 * 1500)", "(id % 3 * 2500000)", "(CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE 'EUR' END)")


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """Postings as one array, whose lines are counted by member."""
    rows = relation(spark, d, "postings").select(
        "id", "title", "location", *[F.expr(x.replace("CASE", "case")).cast(t).alias(c) for x, t, c in zip(_PAY, ("int", "int", "string"), ("salary_from", "salary_to", "salary_currency"), strict=True)]
    )
    folder = _own(spark, "export")
    json_export.export_json(rows, folder)
    members = ("title", "location", "salary_display")
    starts = lambda m: F.startswith("value", F.lit(f'    "{m}": '))
    lines = spark.read.text(folder).select("value", F.coalesce(*[F.when(starts(m), F.lit(m)) for m in members]).alias("member")).where("member is not null")
    value = F.expr("substr(value, length(member) + 9, length(value) - length(member) - 8 - cast(endswith(value, ',') as int))")
    return lines.groupBy("member", value.alias("value")).agg(F.count("*").alias("n"))


_EXPORTED_SQL = f"""SELECT member, coalesce('"' || value || '"', 'null') AS value, count(*) AS n FROM (SELECT unnest(['title', 'location', 'salary_display']) AS member, unnest([title, location, {text.salary_display_sql(*_PAY)}]) AS value FROM postings) GROUP BY ALL"""

# --- streams ------------------------------------------------------------------------------------


def _with_state(spark: SparkSession, make) -> DataFrame:
    """Run a stream that needs RocksDB's state, whatever the session's provider is."""
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    try:
        return make()
    finally:
        spark.conf.set(stateful.PROVIDER, before)


def _replayed(rows: DataFrame, folder: str, files: int, order: str) -> DataFrame:
    """A table as files in an order, which a stream reads two at a time."""
    spark = rows.sparkSession
    rows.repartitionByRange(files, order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(folder)


def _stream_health(spark: SparkSession, d: str) -> DataFrame:
    rows = relation(spark, d, "fetches").select("id", "domain", F.concat(F.lit("u"), F.col("id") % 5).alias("url"), "status", "retry_after")

    def make() -> DataFrame:
        folder = _own(spark, "health")
        # one batch: files carry no order, and a domain's fetches count in order of id within a batch
        rows.write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        return stateful.drained(stateful.crawl_health(stream), f"{folder}/out", f"{folder}/check", "update")

    return _with_state(spark, make).select("domain", "url", "fail_count", "is_active", F.round("delay", 6).alias("delay"), "n_events")


def _health_sql(delays: str) -> str:
    return f""", e AS ({delays}), u AS (SELECT domain, 'u' || id % 5 AS url, id, status FROM fetches),
b AS (SELECT domain, url, count(*) FILTER (status >= 400 AND id > last)::INT AS fail_count FROM (SELECT *, coalesce(max(CASE WHEN status < 400 THEN id END) OVER (PARTITION BY domain, url), -1) AS last FROM u) GROUP BY ALL)
SELECT b.domain, url, fail_count, fail_count < 3 AS is_active, delay, n_events FROM b JOIN e ON e.domain = b.domain"""


def _stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each cache entry is set when it was created; each call asks for one, some too early or too late."""
    at = lambda c: F.timestamp_seconds(F.col(c) + 1_700_000_000)
    sets = relation(spark, d, "cache").select((-F.col("id") - 1).alias("seq"), "key", at("created_at").alias("at"), F.lit("set").alias("op"), "value", F.col("ttl_seconds").cast("int").alias("ttl_seconds"), "tokens_saved")
    calls = relation(spark, d, "calls").select(F.col("id").alias("seq"), F.concat(F.lit("k"), F.col("id") % 3001).alias("key"), (F.col("id") * 17 % 9000).alias("t"))
    gets = calls.select("seq", "key", at("t").alias("at"), F.lit("get").alias("op"), *[F.lit(None).cast(t).alias(c) for c, t in (("value", "string"), ("ttl_seconds", "int"), ("tokens_saved", "int"))])
    log = sets.unionByName(gets)

    def make() -> DataFrame:
        folder = _own(spark, "cache")
        log.write.parquet(f"{folder}/in")
        stream = stateful.cached_answers(spark.readStream.schema(log.schema).parquet(f"{folder}/in"))
        return stateful.drained(stream, f"{folder}/out", f"{folder}/check")

    return _with_state(spark, make).where("what <> 'purged'").select("key", "seq", "what", "value", "hit_count", "tokens_saved")


_CACHE_SQL = """, g AS (SELECT id AS seq, 'k' || id % 3001 AS key, id * 17 % 9000 AS t FROM calls),
h AS (SELECT g.seq, g.key, t, c.value, c.tokens_saved, c.key IS NOT NULL AND created_at <= t AND created_at + ttl_seconds > t AS hit FROM g LEFT JOIN cache c ON c.key = g.key)
SELECT key, seq, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS what, CASE WHEN hit THEN value END AS value,
  CASE WHEN hit THEN count(*) FILTER (hit) OVER (PARTITION BY key ORDER BY t, seq ROWS UNBOUNDED PRECEDING) ELSE 0 END::INT AS hit_count, CASE WHEN hit THEN tokens_saved ELSE 0 END::INT AS tokens_saved FROM h"""

# --- U3, F23, P9, P11, V29 -----------------------------------------------------------------------


def _created(spark: SparkSession, d: str) -> DataFrame:
    sites = relation(spark, d, "sites").withColumn("created_at", F.lit(None).cast("long"))
    wanted = relation(spark, d, "postings").select(F.concat(F.lit("s"), F.col("id") % 50, F.lit(".example.com")).alias("domain"), F.expr("if(id % 50 < 9, '', company)").alias("name"))
    wanted = wanted.union(sites.select("domain", F.lit("other")))
    return enrich.created_sites(sites, wanted, F.lit(7)).select(F.when(F.col("created_at").isNull(), F.col("id")).alias("id"), "domain", "name", "description", "created_at")


_CREATED_SQL = """, n AS (SELECT domain, min(name) AS name FROM (SELECT 's' || id % 50 || '.example.com' AS domain, nullif(CASE WHEN id % 50 < 9 THEN '' ELSE company END, '') AS name FROM postings) GROUP BY 1)
SELECT id, domain, name, description, NULL::BIGINT AS created_at FROM sites UNION ALL SELECT NULL, domain, coalesce(name, domain), NULL, 7 FROM n WHERE domain NOT IN (SELECT domain FROM sites)"""

_words = lambda words, c: "(" + " OR ".join(f"contains(lower({c}), {quote(w)})" for w in words) + ")"
#: An error's text from the words of a part's name; some hold a phrase that says what happened.
_ERROR = (
    "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('All attempts for ', content, ': ', CASE id % 5 WHEN 0 THEN '[Errno 111] Connection refused' WHEN 1 THEN '[SSL: "
    "CERTIFICATE_VERIFY_FAILED]' WHEN 2 THEN 'net::ERR_NAME_NOT_RESOLVED' ELSE content END) END"
)
_BODY = "CASE WHEN id % 4 = 0 THEN '{\"choices\":[]}' WHEN id % 4 = 1 THEN content ELSE concat('{\"choices\":[{\"message\":{\"content\":\"', content, ' ', id, '\"}}]}') END"
_SAID_JOBS = "CASE WHEN id % 4 = 0 THEN '{}' WHEN id % 4 = 1 THEN concat('{\"jobs\":', if(length(content) % 2 = 0, '[]', 'null'), '}') ELSE concat('{\"jobs\":[{\"title\":\"', content, '\"}]}') END"
_DATE = "concat('Mon, ', {f}, ' GMT')"


def _cache(f):
    return lambda spark, d: f(relation(spark, d, "cache"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    said = _DATE.format(f="date_format(timestampadd(second, cast(id * 7919 % 86400 as int), cast(fetched_on as timestamp)), 'dd MMM yyyy HH:mm:ss')")
    return relation(spark, d, "fetches").select("id", text.http_date(F.expr(f"if(retry_after = 'abc', retry_after, {said})")).alias("at"))


# --- J8, L7 by tables of rules ------------------------------------------------------------------

_PHRASES = f"SELECT row_number() OVER (ORDER BY md5(phrase)) AS ordinal, phrase, upper(phrase) AS value FROM (SELECT DISTINCT lower(t) AS phrase FROM {ITEMS}) WHERE phrase <> ''"


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """The items of all pages as a table of phrases, looked for in every page."""
    rows = pages(spark, d)
    words = rows.select(F.explode(F.expr(_ITEMS)).alias("t")).select(F.lower("t").alias("phrase")).where("phrase <> ''").distinct()
    table = words.select(F.expr("row_number() over (order by md5(phrase))").alias("ordinal"), "phrase", F.upper("phrase").alias("value"))
    return phrases.first_phrase(rows.select("page_id", F.lower("html").alias("html")), table, "html").select("page_id", "ordinal", "value")


_RULES = """SELECT lower(substr(n_name, 1, 2)) AS rule FROM nation UNION SELECT concat('co.', lower(substr(n_name, 1, 2))) FROM nation WHERE n_nationkey % 2 = 0
UNION SELECT concat('*.', lower(substr(n_name, 1, 2))) FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT concat('!www.', lower(substr(n_name, 1, 2))) FROM nation WHERE n_nationkey % 5 = 0"""
_HOSTS = """SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN concat('www.', cc) WHEN 1 THEN concat('a.b.co.', cc) WHEN 2 THEN concat('x.y.', cc) WHEN 3 THEN concat('Shop', s_suppkey, '.unknown')
  WHEN 4 THEN cc WHEN 5 THEN concat('10.0.0.', s_suppkey) ELSE concat('größe.', cc) END AS host FROM (SELECT s_suppkey, lower(substr(n_name, 1, 2)) AS cc FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _registered(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "supplier")}
    of = lambda q: spark.sql(q.replace("FROM nation", "FROM {nation}").replace("FROM supplier JOIN nation", "FROM {supplier} JOIN {nation}"), **{t: x for t, x in tables.items() if t in q})
    return phrases.registered_domains(of(_HOSTS), of(_RULES))


_REGISTERED_SQL = f"""WITH r AS ({_RULES}), h AS ({_HOSTS}), s AS (SELECT id, host, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT id, host, string_split(lower(host), '.') AS p FROM h)),
m AS (SELECT id, max(CASE WHEN rule LIKE '!%' THEN 1000 + k - 1 WHEN rule LIKE '*%' THEN k + 1 ELSE k END) % 1000 AS n FROM s JOIN r ON regexp_replace(rule, '^(!|[*][.])', '') = array_to_string(p[-k:], '.') GROUP BY 1)
SELECT h.id, host, CASE WHEN regexp_matches(host, '^[0-9.]*$') THEN NULL WHEN len(p) > coalesce(n, 1) THEN array_to_string(p[-(coalesce(n, 1) + 1):], '.') END AS registered
FROM (SELECT *, string_split(lower(host), '.') AS p FROM h) h LEFT JOIN m ON m.id = h.id"""


# --- P7: a provider that answers from the prompt ------------------------------------------------


def _echo():
    """Answers after as many failures as the prompt says; some prompts it refuses."""
    failed: dict[str, int] = {}

    def call(prompt: str) -> str:
        name, number = prompt.rsplit(" ", 1)
        if int(number) % 7 == 0:
            raise ValueError("bad request")
        failed[prompt] = failed.get(prompt, 0) + 1
        if failed[prompt] <= int(number) % 4:
            raise RuntimeError("503 Service Unavailable")
        return f"{name}!"

    return call


def _model_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = relation(spark, d, "calls").select("id", F.concat("model", F.lit(" "), "id").alias("prompt"))
    return models.answered(rows, F.col("prompt"), _echo, sleep=lambda seconds: None).select("id", "answer", "attempts", "error")


_MODEL_ANSWERS_SQL = """SELECT id, CASE WHEN id % 7 <> 0 AND id % 4 < 3 THEN model || '!' END AS answer, CASE WHEN id % 7 = 0 THEN 1 ELSE least(id % 4 + 1, 3) END::INT AS attempts,
  CASE WHEN id % 7 = 0 THEN 'bad request' WHEN id % 4 = 3 THEN '503 Service Unavailable' END AS error FROM calls"""

# --- X22-X24 on pages of cards ---------------------------------------------------------------------

_MARKUP = (
    '<div class="jobs" id="a{k}" onclick="x()"><!-- c --><script>var a = {k};</script><h2>Alpha {t}</h2>'
    '<p>Jobs <b>for you</b> {k} here</p><ul><li>one {t}</li><li><a href="/j/{k}">link {t}</a></li></ul></div>'
)
_CLEANED = "'<div class=\"jobs\" id=\"a' || k || '\"><h2>Alpha ' || t || '</h2><p>Jobs <b>for you</b> ' || k || ' here</p><ul><li>one ' || t || '</li><li><a href=\"/j/' || k || '\">link ' || t || '</a></li></ul></div>'"
_MARKED = "'## Alpha ' || t || chr(10) || 'Jobs **for you** ' || k || ' here' || chr(10) || '- one ' || t || chr(10) || '- [link ' || t || '](/j/' || k || ')'"
#: A card as the section holds it: its markup without the comment, and without attributes that aren't kept.
_RAW = "'<div class=\"jobs\" id=\"a' || k || '\"><script>var a = ' || k || ';</script><h2>Alpha ' || t || '</h2><p>Jobs <b>for you</b> ' || k || ' here</p><ul><li>one ' || t || '</li><li><a href=\"/j/' || k || '\">link ' || t || '</a></li></ul></div>'"


def _markup(spark: SparkSession, d: str, **around: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.expr(cards(_MARKUP, **around)).alias("html"))


def _joined_sql(one: str, sep: str, name: str) -> str:
    return f"SELECT p.page_id, coalesce(string_agg({one}, {sep} ORDER BY k), '') AS {name} FROM pages p LEFT JOIN {ITEMS} i ON i.page_id = p.page_id GROUP BY 1"


QUERIES = {
    "p7_model_answers": _model_answers,
    "x23_clean_cards": lambda spark, d: _markup(spark, d).select("page_id", markup.clean_html(F.col("html")).alias("clean")),
    "x24_markdown_cards": lambda spark, d: _markup(spark, d).select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown")),
    "x22_section_cards": lambda spark, d: _markup(spark, d, before='<nav>no</nav><div class="job-list-x">', after="</div>").select(
        "page_id", F.regexp_replace(markup.clean_html(markup.find_job_section(F.col("html"))), r"\s+$", "").alias("section")
    ),
    "j8_phrases": _phrases,
    "l7_public_suffixes": _registered,
    "x5_x14b_lateral": _lateral,
    "sc9_sc10_searches": _searches,
    "e8_followed_pages": _crawls,
    "j6_translations": lambda spark, d: postings.with_translations(_titles(spark, d)),
    "f19_good_translations": _good,
    "x26_x27_cascade": _cascade,
    "x28_answers": _fallback,
    "sk1_json_array": _exported,
    "e1_e2_e4_stream": _stream_health,
    "e7_stream_cache": _stream_cache,
    "u3_created_sites": _created,
    "f23_failures": _cache(lambda df: df.select("id", reports.failure(F.expr(_ERROR)).alias("failure"))),
    "p9_p11_answers": _cache(lambda df: df.select("id", text.answer_content(F.expr(_BODY)).alias("content"), text.is_empty_result(F.expr(_SAID_JOBS)).alias("empty"))),
    "v29_http_dates": _dates,
}


def sql(delays: str) -> dict[str, str]:
    """DuckDB's side; ``delays`` is that of E4 on the fetches as they are."""
    if_ = lambda x: x.replace("if(length(content) % 2 = 0, '[]', 'null')", "CASE WHEN length(content) % 2 = 0 THEN '[]' ELSE 'null' END")
    return {
        "p7_model_answers": with_relations(_MODEL_ANSWERS_SQL, "calls"),
        "x23_clean_cards": _joined_sql(_CLEANED, "''", "clean"),
        "x24_markdown_cards": _joined_sql(_MARKED, "chr(10)", "markdown"),
        "x22_section_cards": f"SELECT page_id, CASE WHEN n > 1000 THEN clean ELSE '' END AS section FROM ({_joined_sql(_CLEANED, "''", 'clean')}) JOIN (SELECT page_id, sum(length({_RAW})) AS n FROM {ITEMS} GROUP BY 1) USING (page_id)",
        "j8_phrases": f"WITH w AS ({_PHRASES}) SELECT page_id, min(ordinal) AS ordinal, arg_min(value, ordinal) AS value FROM pages LEFT JOIN w ON contains(lower(html), phrase) GROUP BY 1",
        "l7_public_suffixes": _REGISTERED_SQL,
        "x5_x14b_lateral": _LATERAL_SQL,
        "sc9_sc10_searches": _SEARCHES_SQL,
        "e8_followed_pages": _CRAWLS_SQL,
        "j6_translations": f"SELECT page_id, pos::INT AS pos, title, title_en FROM ({_SAID_SQL})",
        "f19_good_translations": (
            f"SELECT p.page_id, coalesce(good, true) AS good FROM pages p LEFT JOIN (SELECT page_id, bool_and(title_en IS NOT NULL AND NOT {text.bad_translation_sql('title_en')}) "
            f"AS good FROM ({_SAID_SQL}) GROUP BY 1) g ON g.page_id = p.page_id"
        ),
        "x26_x27_cascade": _CASCADE_SQL,
        "x28_answers": _FALLBACK_SQL,
        "sk1_json_array": with_relations(_EXPORTED_SQL, "postings"),
        "e1_e2_e4_stream": with_relations(_health_sql(delays), "fetches"),
        "e7_stream_cache": with_relations(_CACHE_SQL, "cache", "calls"),
        "u3_created_sites": with_relations(_CREATED_SQL, "sites", "postings"),
        "f23_failures": with_relations(
            (
                f"SELECT id, CASE WHEN e IS NULL THEN NULL WHEN {_words(reports.UNREACHABLE, 'e')} THEN 'unreachable' WHEN {_words(reports.CERTIFICATE, 'e')} THEN 'certificate' "
                f"ELSE 'error' END AS failure FROM (SELECT id, {_ERROR} AS e FROM cache)"
            ), "cache"
        ),
        "p9_p11_answers": with_relations(
            f"SELECT id, CASE WHEN id % 4 < 2 THEN '' ELSE content || ' ' || id END AS content, id % 4 < 2 AS empty FROM (SELECT *, {if_(_BODY)} AS body FROM cache)", "cache"
        ),
        "v29_http_dates": with_relations("SELECT id, CASE WHEN retry_after <> 'abc' THEN fetched_on::TIMESTAMP + to_seconds(id * 7919 % 86400) END AS at FROM fetches", "fetches"),
    }

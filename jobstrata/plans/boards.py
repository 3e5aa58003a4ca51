"""Extraction queries over the stored pages.

A page's own navigation gives its postings: each ``<li><a href="/word">`` of
the stored html becomes a card of the platform in question, in front of the
page itself, so pages differ in number and wording of their postings.  The SQL
cuts the same words out of the html and says what each card must lead to.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.rewrite import quote
from ..operators import enrich, extract
from ..sources import files
from . import write_path

ITEM = '<li><a href="/([^"]*)">'


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    extract.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def filled(template: str, word: str, number: str) -> str:
    """SQL text of a template: {t} stands for the word, {k} for its number."""
    return "concat(" + ", ".join({"{t}": word, "{k}": f"cast({number} as string)"}.get(p, quote(p)) for p in re.split(r"(\{[tk]\})", template) if p) + ")"


def cards(template: str, before: str = "", after: str = "", sep: str = "") -> str:
    """Spark SQL: the cards of a page."""
    words = f"regexp_extract_all(html, {quote(ITEM)}, 1)"
    return f"concat({quote(before)}, array_join(transform({words}, (t, k) -> {filled(template, 't', 'k')}), {quote(sep)}), {quote(after)})"


#: DuckDB: page_id, word t and number k of each item.
ITEMS = f"(SELECT page_id, url AS page_url, unnest(ts) AS t, unnest(range(len(ts))) AS k FROM (SELECT page_id, url, regexp_extract_all(html, {quote(ITEM)}, 1) AS ts FROM pages))"

BOARDS: dict[str, dict] = {
    "x1_json_ld": dict(
        platform=None, url="https://a.b/c", before='<script type="application/ld+json">{"@graph":[', after=',{"@type":"JobPosting","title":"Open Application"},{"@type":"Person","title":"no"}]}</script>', sep=",",
        card='{"@type":"JobPosting","title":"Engineer {t}","url":"/j/{k}","industry":"IT","jobLocation":{"address":{"addressLocality":"Berlin"}},"hiringOrganization":{"name":"Acme {k}"}}',
        title="'Engineer ' || t", location="'Berlin'", link="'https://a.b/j/' || k", department="'IT'", company="'Acme ' || k",
    ),
    "x2_microdata": dict(
        platform=None, url="https://a.b/c", title="'Developer ' || t", location="'Graz'", link="'https://a.b/j/' || k",
        card='<div itemtype="https://schema.org/JobPosting"><b itemprop="title">Developer {t}</b><a itemprop="url" href="/j/{k}"></a><i itemprop="jobLocation"><u itemprop="addressLocality">Graz</u></i></div>',
    ),
    "x4_v15_personio": dict(
        platform="personio", url="https://a.jobs.personio.de/", title="'Analyst ' || t", location="'Köln'", link="'https://a.jobs.personio.de/job/' || k",
        card='<a href="/job/{k}">Analyst {t} (all)Permanent employee, Full-time·Köln·Remote</a><a href="/job/{k}">again</a>',
    ),
    "x5_greenhouse": dict(
        platform="greenhouse", url="https://boards.greenhouse.io/a", title="'Developer ' || t", location="'Berlin'", link="'https://boards.greenhouse.io/a/jobs/' || k", department="'Unit ' || k",
        card='<section><h3>Unit {k}</h3><a href="/a/jobs/{k}"><p>Developer {t} New</p><p>Berlin</p></a></section>',
    ),
    "x6_x25_lever": dict(
        platform="lever", url="https://jobs.lever.co/acme", title="'Developer ' || t", location="'Wien ' || k", link="'https://jobs.lever.co/acme/' || k",
        card='<div class="posting"><h5>Developer {t}</h5><a href="/acme/{k}">x</a><span class="location">Wien {k}</span></div>', after='<div class="posting"><h5>Initiativbewerbung</h5></div>',
    ),
    "x7_v19_deloitte": dict(
        platform="deloitte", url="https://job.deloitte.com/search?search=data", title="'Data Analyst ' || t", location="'Berlin'", link="'https://job.deloitte.com/job-data_' || k",
        card='<div>Berlin <a href="/job-data_{k}">Data Analyst {t}</a><a href="/job-other_{k}">Clerk {t}</a></div>',
    ),
    "x8_v16_workable": dict(
        platform="workable", url="https://apply.workable.com/a", title="'QA Engineer ' || t", location="'Cluj, Romania'", link="'https://apply.workable.com/a/j/' || k", department="'QA'",
        card='<li class="job"><a href="/a/j/{k}">QA Engineer {t}</a> Remote Cluj, Romania All, QA Full time</li>',
    ),
    "x9_recruitee": dict(
        platform="recruitee", url="https://a.recruitee.com", before='<script>x = {"offers": [', after='], "z":1}</script>', sep=",", title="'Developer ' || t", location="'Bonn'", link="'https://y/' || k",
        card='{"title":"Developer {t}","city":"Bonn","careers_url":"https://y/{k}"}',
    ),
    "x11_odoo": dict(
        platform="odoo", url="https://o", title="'Developer ' || t", location="'Hauptsitz Köln'", link="'https://o/jobs/detail/' || k",
        card='<div class="card card-default"><a href="/jobs/detail/{k}"><h3>Developer {t}</h3></a><span>Hauptsitz Köln</span></div>',
    ),
    "x12_v18_hrworks": dict(
        platform="hrworks", url="https://h", title="'Developer ' || t", location="'Linz'", link="'https://h/x?id=' || k", department="'IT'",
        card='<div class="portlet"><a class="job-offer-content" href="/x?id={k}"><h2>Developer {t}</h2></a><div class="margin-top-10">IT - Vollzeit</div><a><i class="icomoon-location"></i><span>Linz</span></a></div>',
    ),
    "x13_v11_v17_hibob": dict(
        platform="hibob", url="https://a.careers.hibob.com", title="'QA ' || t || ' ' || k || ' (m/w/d)'", location="'Germany, Remote'", department="'IT'",
        link="'https://a.careers.hibob.com/' || trim(regexp_replace(lower('QA ' || t || ' ' || k), '[^a-z0-9]+', '-', 'g'), '-')",
        card='<b-virtual-scroll-list-item><b-heading>QA {t} {k} (m/w/d)</b-heading><div>IT · Remote Germany · Full-time</div></b-virtual-scroll-list-item>',
    ),
    "x14a_softgarden": dict(
        platform="softgarden", url="https://a.softgarden.io", title="'Developer ' || t", location="'Graz'", link="'https://a.softgarden.io/job/' || k",
        card='<li><a href="/job/{k}">Developer {t} (all genders) – Jetzt bewerben!</a><span class="location">Graz</span></li><a href="/job/?page={k}">next</a>',
    ),
    "x14b_join": dict(
        platform="join", url="https://join.com/companies/a", title="'Clerk ' || t", location="'Ulm'", link="'https://join.com/companies/a/jobs/' || k",
        card='<article class="job-x"><a href="/companies/a/jobs/{k}"><h3>Clerk {t}</h3></a><span class="city">Ulm</span></article>',
    ),
    "x15_stepstone": dict(
        platform="stepstone", url="https://www.stepstone.de", title="'Developer ' || t", location="'Germany'", link="'https://www.stepstone.de/x--' || k", company="'Acme ' || k",
        card='<article data-at="job-item"><h2>Developer {t}</h2><a href="/x--{k}">l</a><span data-at="job-item-company-name">Acme {k}</span></article>',
    ),
    "x16_karriere": dict(
        platform="karriere", url="https://www.karriere.at", title="'Software Developer ' || t", location="'Austria'", link="'https://www.karriere.at/jobs/' || k",
        card='<p><a href="/jobs/{k}">Software Developer {t}</a></p>',
    ),
}


def board_pages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    b = BOARDS[name]
    html = F.concat(F.expr(cards(b["card"], b.get("before", ""), b.get("after", ""), b.get("sep", ""))), "html")
    return pages(spark, sf_dir).select("page_id", F.lit(b["url"]).alias("url"), html.alias("html"), F.lit(b["platform"]).cast("string").alias("platform"))


def board_sql(name: str) -> str:
    b = BOARDS[name]
    method = "schema_org" if b["platform"] is None else f"job_board:{b['platform']}"
    return (
        f"SELECT page_id, k AS pos, '{method}' AS method, {b['title']} AS title, {b['location']} AS location, {b['link']} AS url, "
        f"{b.get('department', 'NULL::VARCHAR')} AS department, {b.get('company', 'NULL::VARCHAR')} AS company FROM {ITEMS}"
    )


def _board(name: str):
    return lambda spark, d: extract.extracted(board_pages(spark, d, name))


def _links(spark: SparkSession, d: str, card: str, **around: str) -> DataFrame:
    html = F.concat(F.expr(cards(card, **around)), "html")
    return extract.links(pages(spark, d).select("page_id", F.lit("https://a.b/c").alias("url"), html.alias("html")))


def _offers(spark: SparkSession, d: str) -> DataFrame:
    card = '{"title":"Dev {t}","city":"Graz","country":"AT","slug":"s{k}"},{"title":""},{"title":"Ops {t}","location":"Remote","careers_url":"https://x/{k}"}'
    body = F.expr(cards(card, '{"offers":[', "]}", ","))
    return extract.api_offers(pages(spark, d).select(F.concat(F.lit("https://s"), "page_id", F.lit(".recruitee.com/x")).alias("site_url"), body.alias("body")))


_VACANCY = '{"id":"{k}","name":"Dev {t}","alternate_url":"https://hh/{k}","area":{"name":"Kazan"},"salary":{"from":{k},"currency":"RUR"},"description":"about {t}","key_skills":[{"name":"sql"},{"name":"{t}"}]}'
_BOARD_CARD = '<a href="/x/{k}"></a><iframe src="https://x.jobs.personio.de/job/{k}?language=de"></iframe><a href="https://x.jobs.personio.de/privacy-policy">p</a>'
_SCRIPT_CARD = '<script>var c = {"u": "https://boards.greenhouse.io/co{k}/jobs/7"};</script>'
_DOCS = '<a href="/f/Stellenausschreibung_Techniker-Ort{k}x_20240101.pdf">x</a><a href="/f/agb{k}.pdf">y</a><a href="/z{k}.pdf?job">z</a>'
_LOC = "<url><loc> https://s/{t}?a=1&amp;b=&#39;{k}&#39; </loc></url>"

_JOB_CARD = '<div class="posting"><h5>Developer {t}</h5><a href="/acme/{t}-{k}">x</a><span class="location">Wien {k}</span></div>'
_NOW = 10**9


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as an earlier scan left them: the even items and one job of each page that is gone."""
    items = pages(spark, d).select("page_id", F.posexplode(F.expr(f"regexp_extract_all(html, {quote(ITEM)}, 1)")).alias("k", "t"))
    even = items.where("k % 2 = 0").select((F.col("page_id") * 100 + F.col("k")).alias("id"), "page_id", F.concat(F.lit("DEVELOPER "), "t", F.lit(" (m/w/d)")).alias("title"), F.concat(F.lit("Wien "), "k").alias("location"), (F.col("k") % 4 == 0).alias("is_active"))
    old = pages(spark, d).select((F.col("page_id") * 100 + 99).alias("id"), "page_id", F.concat(F.lit("Old "), "page_id").alias("title"), F.lit(None).cast("string").alias("location"), F.lit(True).alias("is_active"))
    return even.unionByName(old).select(
        "id", F.floor(F.col("page_id") / 3).alias("site_id"), F.lit(None).cast("string").alias("external_id"), "title", F.lit("Acme").alias("company"), "location", F.lit("u").alias("url"), "is_active",
        F.lit(None).cast("string").alias("extraction_method"), F.lit(1).cast("long").alias("first_seen_at"), F.lit(1).cast("long").alias("last_seen_at"),
    )


def _catalog_update(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select(
        "page_id", F.floor(F.col("page_id") / 3).alias("site_id"), (F.col("page_id") % 3 + 1).cast("int").alias("page_no"), F.lit("https://jobs.lever.co/acme").alias("url"),
        F.concat(F.expr(cards(_JOB_CARD)), "html").alias("html"), F.lit("lever").alias("platform"),
    )
    sites = rows.select("site_id").distinct().withColumn("url", F.concat(F.lit("https://www.site-"), F.col("site_id").cast("string"), F.lit(".com/x")))
    waiting = spark.createDataFrame([], "site_id long, suspicious_count int")
    return write_path.catalog_update(rows, sites, _stored(spark, d), waiting, F.lit(_NOW).cast("long")).jobs.drop("id")


_UPDATE_SQL = f"""WITH i AS (SELECT page_id, page_id // 3 AS site_id, page_id % 3 + 1 AS page_no, k, t, 'https://jobs.lever.co/acme/' || t || '-' || k AS url FROM {ITEMS}),
p AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY page_id, {text.candidate_title_sql("('Developer ' || t)")} ORDER BY k) = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY page_no, k, page_id) - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY page_no, k, page_id) AS u FROM p) WHERE u = 1),
s AS (SELECT page_id * 100 + k AS id, site_id, 'DEVELOPER ' || t || ' (m/w/d)' AS title, 'Wien ' || k AS location, k % 4 = 0 AS is_active, lower(trim('developer ' || t)) AS kt, 'wien ' || k AS kl FROM i WHERE k % 2 = 0
  UNION ALL SELECT page_id * 100 + 99, page_id // 3, 'Old ' || page_id, NULL, true, 'old ' || page_id, '' FROM pages),
o AS (SELECT site_id, kt, kl, max(id) AS id FROM s GROUP BY ALL),
w AS (SELECT site_id, lower(trim('developer ' || t)) AS kt, 'wien ' || k AS kl, arg_min({{'t': t, 'k': k, 'n': n, 'url': url}}, n) AS r FROM d GROUP BY ALL),
c AS (SELECT coalesce(o.site_id, w.site_id) AS site_id, o.id, r, w.site_id IS NOT NULL AS found FROM o FULL JOIN w ON o.site_id = w.site_id AND o.kt = w.kt AND o.kl = w.kl)
SELECT s.site_id, NULL AS external_id, title, 'Acme' AS company, location, 'u' AS url, CASE WHEN c.id IS NULL THEN is_active ELSE found END AS is_active, NULL AS extraction_method, 1::BIGINT AS first_seen_at, CASE WHEN c.id IS NOT NULL AND found THEN {_NOW} ELSE 1 END::BIGINT AS last_seen_at
  FROM s LEFT JOIN c ON c.id = s.id
UNION ALL SELECT site_id, 'web-www.site-' || site_id || '.com-' || r.n, 'Developer ' || r.t, 'Site-' || site_id, 'Wien ' || r.k, r.url, true, 'job_board:lever', {_NOW}, {_NOW} FROM c WHERE id IS NULL"""


def _at_boards(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).withColumn("platform", F.when(F.col("page_id") % 3 == 0, F.lit("lever")))
    boards = rows.select("page_id", F.lit("personio").alias("platform"), F.concat(F.lit("https://b"), F.col("page_id") % 40, F.lit(".jobs.personio.de/")).alias("board_url"))
    landed = spark.range(30).select(F.concat(F.lit("https://b"), "id", F.lit(".jobs.personio.de/")).alias("url"), F.concat(F.lit("<p>board "), "id").alias("html"))
    return enrich.at_boards(rows, boards, landed).select("page_id", "url", F.length("html").alias("size"), "platform", "external")


def _site_urls(spark: SparkSession, d: str) -> DataFrame:
    """Each site's robots file names three sitemaps: one that isn't XML, an index
    of three, and one that comes too late; every other site has a plain second."""
    rows = pages(spark, d).select(F.col("page_id").alias("site"), "html")
    at = lambda n: F.concat(F.lit(f"https://s/{n}/"), F.col("site"))
    locations = rows.select("site", F.posexplode(F.array(at("a"), at("b"), at("c"))).alias("ord", "url"))
    index = F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), at(n), F.lit("</loc></sitemap>")) for n in ("x", "y", "z")], F.lit("</sitemapindex>"))
    plain = F.expr(cards("<url><loc>https://s/{t}</loc></url>", "<urlset>", "</urlset>"))
    docs = [(at("a"), F.lit("not found")), (at("b"), F.when(F.col("site") % 2 == 0, index).otherwise(plain)), (at("c"), F.lit("<urlset><url><loc>late</loc></url></urlset>")), *[(at(n), plain) for n in ("x", "y", "z")]]
    sitemaps = rows.select(F.explode(F.array(*[F.struct(u.alias("url"), x.alias("xml")) for u, x in docs])).alias("s")).select("s.*")
    return files.site_urls(locations, sitemaps)


QUERIES = {name: _board(name) for name in BOARDS} | {
    "u2_pages_to_catalog": _catalog_update,
    "p3_at_boards": _at_boards,
    "sc13_site_urls": _site_urls,
    "x10_sc11_api_offers": _offers,
    "x20_sc7_vacancies": lambda spark, d: extract.vacancies(pages(spark, d).select(F.expr(cards(_VACANCY, '{"items":[', "]}", ",")).alias("body"))).select("id", "title", "company", "location", "url", "salary_from", "salary_to", "salary_currency"),
    "sc8_vacancy_details": lambda spark, d: extract.vacancy_details(
        pages(spark, d).select(F.explode(F.split(F.expr(cards(_VACANCY, sep="\x01")), "\x01")).alias("body"))
    ).withColumn("skills", F.array_join("skills", ", ")),
    "x17_links": lambda spark, d: extract.distinct_links(extract.links(pages(spark, d))).select("page_id", "pos", "url", "label"),
    "x3_document_postings": lambda spark, d: extract.document_postings(_links(spark, d, _DOCS)),
    "x18_external_board": lambda spark, d: extract.external_boards(_links(spark, d, _BOARD_CARD)),
    "x18_script_board": lambda spark, d: extract.external_boards(_links(spark, d, _SCRIPT_CARD)),
    "x19_careers_link": lambda spark, d: extract.careers_links(_links(spark, d, '<a href="/{t}{k}">{t}</a><a href="/karriere/{k}">x</a><a href="/y{k}">Jobs bei uns</a>')),
    "f11_f12_listing_link": lambda spark, d: extract.listing_links(_links(spark, d, '<a href="/x/job/{k}">Alle Stellen</a><a href="/all{k}">See all positions</a><a href="/{k}/careers">Karriere</a>')),
    "sc13_sc14_sitemap": lambda spark, d: files.sitemap_urls(pages(spark, d).select("url", F.expr(cards(_LOC, '<?xml version="1.0"?><urlset>', "</urlset>")).alias("xml"))),
    "sc12_robots": lambda spark, d: files.robots_sitemaps(pages(spark, d).select("url", F.expr(cards("Sitemap: https://s/{t}.xml\ndisallow: /{k}\n", "User-agent: *\n")).alias("body"))),
    "l2_joined_urls": lambda spark, d: pages(spark, d).select("page_id", "url", F.posexplode(F.expr(f"regexp_extract_all(html, {quote(ITEM)}, 1)")).alias("pos", "t"))
    .select("page_id", "pos", extract.joined_urls(F.col("url"), F.concat(F.lit("../e/"), F.regexp_replace("t", "[?#;:]", ""))).alias("joined")),
    "f14_platform_by_html": lambda spark, d: pages(spark, d).select("page_id", urls.platform(F.col("url"), F.expr((
        "concat(html, case page_id % 4 when 0 then '<div class=\"Talention-x\">' when 1 then '<a href=\"https://HRWorks/x\">' when 2 then '<i data-join=\"1\">' "
        "else '' end)"
    ))).alias("platform")),
    "l12_answer_urls": lambda spark, d: extract.answer_urls(pages(spark, d).select("page_id", F.lit("https://a.b/c/d").alias("url"), F.expr(cards('" /j/{t} ", "x{k}", 7, "", "https://z/{k}", "/j/{t}"', "[", "]", ", ")).alias("answer"))),
}

SQL = {name: board_sql(name) for name in BOARDS} | {
    "u2_pages_to_catalog": _UPDATE_SQL,
    "p3_at_boards": (
        "SELECT page_id, CASE WHEN e THEN 'https://b' || page_id % 40 || '.jobs.personio.de/' ELSE url END AS url, CASE WHEN e THEN length('<p>board ' || page_id "
        "% 40) ELSE length(html) END AS size, CASE WHEN e THEN 'personio' WHEN page_id % 3 = 0 THEN 'lever' END AS platform, e AS external "
        "FROM (SELECT *, page_id % 3 <> 0 AND page_id % 40 < 30 AS e FROM pages)"
    ),
    "sc13_site_urls": f"""SELECT page_id AS site, (k + c * (SELECT count(*) FROM {ITEMS} j WHERE j.page_id = i.page_id))::INT AS pos, 'https://s/' || t AS loc FROM {ITEMS} i, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR page_id % 2 = 0""",
    "x10_sc11_api_offers": f"""SELECT 'https://s' || page_id || '.recruitee.com/x' AS site_url, (3 * k)::INT AS pos, 'Dev ' || t AS title, 'Graz, AT' AS location, 'https://s' || page_id || '.recruitee.com/o/s' || k AS url, NULL::VARCHAR AS department FROM {ITEMS}
       UNION ALL SELECT 'https://s' || page_id || '.recruitee.com/x', (3 * k + 2)::INT, 'Ops ' || t, 'Remote', 'https://x/' || k, NULL FROM {ITEMS}""",
    "x20_sc7_vacancies": (
        f"SELECT k::VARCHAR AS id, 'Dev ' || t AS title, 'Unknown' AS company, 'Kazan' AS location, 'https://hh/' || k AS url, k::INT AS salary_from, NULL::INT AS "
        f"salary_to, 'RUR' AS salary_currency FROM {ITEMS}"
    ),
    "sc8_vacancy_details": f"SELECT k::VARCHAR AS id, 'about ' || t AS description, 'sql, ' || t AS skills FROM {ITEMS}",
    "x17_links": """SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::BIGINT AS pos, u AS url, u || ' [' || left(x, 50) || ']' AS label
       FROM (SELECT page_id, u, min(k) AS k, arg_min(x, k) AS x FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || h AS u, x, k
         FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS x, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS k FROM pages)) GROUP BY page_id, u)""",
    "x3_document_postings": f"SELECT page_id, (3 * k)::BIGINT AS pos, 'Techniker-Ort' || k || 'x' AS title, 'https://a.b/f/Stellenausschreibung_Techniker-Ort' || k || 'x_20240101.pdf' AS url FROM {ITEMS}",
    "x18_external_board": f"SELECT page_id, 'personio' AS platform, 'https://x.jobs.personio.de/?language=de' AS board_url FROM {ITEMS} WHERE k = 0",
    "x18_script_board": f"SELECT page_id, 'greenhouse' AS platform, 'https://boards.greenhouse.io/co0' AS board_url FROM {ITEMS} WHERE k = 0",
    "x19_careers_link": f"SELECT page_id, 'https://a.b/karriere/0' AS careers_url FROM {ITEMS} WHERE k = 0",
    "f11_f12_listing_link": f"SELECT page_id, 'https://a.b/0/careers' AS listing_url FROM {ITEMS} WHERE k = 0",
    "sc13_sc14_sitemap": f"SELECT page_url AS url, false AS is_index, k::INT AS pos, 'https://s/' || t || '?a=1&b=''' || k || '''' AS loc FROM {ITEMS}",
    "sc12_robots": f"SELECT page_url AS url, (2 * k + 1)::INT AS pos, 'https://s/' || t || '.xml' AS sitemap FROM {ITEMS}",
    "l2_joined_urls": f"""SELECT page_id, k::INT AS pos, regexp_extract(page_url, '^(https?://[^/]+)', 1) || CASE WHEN len(f) > 2 THEN '/' || array_to_string(f[1:len(f) - 2], '/') ELSE '' END || '/e/' || w AS joined
       FROM (SELECT page_id, page_url, k, regexp_replace(t, '[?#;:]', '', 'g') AS w, string_split(regexp_extract(page_url, '^https?://[^/]+/([^?#]*)', 1), '/') AS f FROM {ITEMS})""",
    "f14_platform_by_html": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'talention' WHEN 1 THEN 'hrworks' WHEN 2 THEN 'join' END AS platform FROM pages",
    "l12_answer_urls": f"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY first) - 1)::INT AS pos, u AS url FROM (SELECT page_id, u, min(o) AS first FROM (
       SELECT page_id, 'https://a.b/j/' || t AS u, 6 * k AS o FROM {ITEMS} UNION ALL SELECT page_id, 'https://a.b/c/x' || k, 6 * k + 1 FROM {ITEMS} UNION ALL SELECT page_id, 'https://z/' || k, 6 * k + 4 FROM {ITEMS}) GROUP BY ALL)""",
}

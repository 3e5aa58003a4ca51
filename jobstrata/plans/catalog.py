"""The catalog's relations, made from the star-schema tables.

``relation_sql(dialect)`` gives each relation as one SELECT, in Spark's or
DuckDB's spelling; Spark operators get them as DataFrames.  Suppliers stand
for sites, line items for postings seen in a scan, orders for fetches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.rewrite import quote

TITLES = [
    "Senior Entwickler (m/w/d)", "Software Engineer (f/d/m)", "Projektleiter m/w/d", "Data Analyst  ", "Initiativbewerbung",
    "Werkstudent im Vertrieb", "Sachbearbeiter für Einkauf und Logistik", "Teamleiter Kundenservice - Vollzeit: 30.000 - 40.000 Euro",
    "Backend Engineer (m/w/d)Backend Engineer (m/w/d)", "Impressum", "Systemadministrator Job posting", "QA Lead apply now", "Open Application",
    "Berater in Teilzeit", "C++ Developer", "Product Manager – Remote",
]
PLACES = [
    "Berlin, Germany", "Berlin", "München, Deutschland", "Remote", "Unknown", "Wien, Österreich", "Hamburg, Vollzeit", "Köln inkl. Home Office",
    "Berlin, Germany, Remote", "Zürich, Schweiz,", "n/a", "London, UK",
]
HOSTS = [
    "https://acme.jobs.personio.de/job/", "https://boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme/", "https://apply.workable.com/acme/j/",
    "https://acme.recruitee.com/o/", "https://www.2rsoftware.de/karriere?q=engineer&id=", "https://my-company.com/careers/", "https://acme.careers.hibob.com/x",
    "https://job.deloitte.com/search?search=data+analyst&id=", "https://acme.softgarden.io/job/", "https://join.com/companies/acme/", "http://example.org/privacy-policy?x=",
]
DEPARTMENTS = ["Engineering", "Sales", "", "Operations"]
PLATFORM_METHODS = ["schema_org", "llm", "pdf_link", "job_board:personio"]


def pick(values: list[str], key: str, dialect: str) -> str:
    items = ", ".join(map(quote, values))
    index = f"CAST(1 + ({key}) % {len(values)} AS INT)"
    return f"element_at(array({items}), {index})" if dialect == "spark" else f"([{items}])[{index}]"


def relation_sql(dialect: str) -> dict[str, str]:
    p = lambda values, key: pick(values, key, dialect)
    day = (lambda c: f"CAST({c} AS DATE)") if dialect == "duckdb" else (lambda c: f"CAST({c} AS DATE)")
    return {
        # postings as parsers give them: one row for each place on a page
        "postings": f"""
            SELECT CAST((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS BIGINT) AS id, CAST(l_suppkey AS BIGINT) AS site_id,
                   CAST(l_linenumber AS INT) AS page_no, CAST(l_orderkey AS BIGINT) AS pos,
                   {p(TITLES, "l_partkey * 7 + l_linenumber")} AS title,
                   CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE {p(PLACES, "l_partkey + l_suppkey")} END AS location,
                   CASE WHEN l_partkey % 13 = 0 THEN 'None' WHEN l_partkey % 17 = 0 THEN NULL
                        WHEN l_partkey % 19 = 0 THEN 'https://acme.example/jobs/#'
                        ELSE concat({p(HOSTS, "l_partkey")}, CAST(l_partkey % 97 AS VARCHAR(20))) END AS url,
                   {p(DEPARTMENTS, "l_partkey")} AS department,
                   CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('2r software ', CAST(l_partkey % 3 AS VARCHAR(20))) END AS company,
                   {p(PLATFORM_METHODS, "l_orderkey")} AS method,
                   {day("l_shipdate")} AS seen_on
            FROM lineitem""",
        "sites": f"""
            SELECT CAST(s_suppkey AS BIGINT) AS id, concat(lower(replace(s_name, '#', '-')), '.example.com') AS domain, s_name AS name,
                   CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN NULL ELSE concat('about ', s_name) END AS description,
                   CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey * 37 % 1000 AS BIGINT) END AS last_scanned_at
            FROM supplier""",
        # stored jobs: ids in order of arrival
        "jobs": f"""
            SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 100 + 1 AS BIGINT) AS site_id,
                   concat({p(TITLES, "o_custkey * 7 + o_orderkey")}, CASE WHEN o_orderkey % 10 = 0 THEN ' II' ELSE '' END) AS title,
                   CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {p(PLACES, "o_custkey + o_orderkey")} END AS location,
                   CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('https://jobs.example/', CAST(o_orderkey AS VARCHAR(20))) END AS url,
                   CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Acme' END AS company,
                   o_orderstatus = 'O' AS is_active, CAST(o_custkey % 50 AS BIGINT) AS first_seen_at, CAST(o_custkey AS BIGINT) AS last_seen_at
            FROM orders""",
        # a later scan, of very uneven size from site to site
        "rescan": f"""
            SELECT CAST((l_orderkey * l_orderkey) % 100 + 1 AS BIGINT) AS site_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos,
                   {p(TITLES, "l_partkey * 7 + l_linenumber")} AS title, {p(PLACES, "l_partkey + l_suppkey")} AS location,
                   concat({p(HOSTS, "l_partkey")}, CAST(l_partkey % 97 AS VARCHAR(20))) AS url
            FROM lineitem""",
        "history": f"""
            SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey AS BIGINT) AS job_id,
                   {p(["added", "removed", "reactivated"], "o_custkey")} AS event, {day("o_orderdate")} AS changed_on,
                   CASE o_custkey % 9 WHEN 0 THEN concat(CAST({day("o_orderdate")} AS VARCHAR(10)), ' at noon') WHEN 1 THEN CAST({day("o_orderdate")} AS VARCHAR(10)) WHEN 2 THEN NULL
                        ELSE concat(CAST({day("o_orderdate")} AS VARCHAR(10)), ' 1', CAST(o_custkey % 10 AS VARCHAR(1)), ':', CAST(10 + o_orderkey % 50 AS VARCHAR(2)), ':00') END AS changed_at
            FROM orders""",
        "career_urls": f"""
            SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 100 + 1 AS BIGINT) AS site_id,
                   concat('https://site', CAST(c_custkey % 100 AS VARCHAR(20)), '.example.com', {p(["/careers", "/job", "/stellen.html", "/en/people-jobs", "/jobs/", "/a-very-long-slug-for-one-single-position-only"], "c_custkey")}) AS url,
                   {p(["personio", "lever", "", "workable"], "c_custkey * 3")} AS platform, c_custkey % 3 <> 0 AS is_active,
                   CAST(c_custkey % 4 AS INT) AS fail_count, CAST(c_custkey % 5 AS INT) AS suspicious_count,
                   CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey * 13 % 997 AS BIGINT) END AS last_success_at
            FROM customer""",
        "cache": f"""
            SELECT CAST(p_partkey AS BIGINT) AS id, concat('k', CAST(p_partkey AS VARCHAR(20))) AS key, p_type AS value, {p(["jobs", "translation", "url", "company"], "p_partkey")} AS namespace, p_name AS content,
                   CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS model,
                   CAST(p_size * 100 AS BIGINT) AS ttl_seconds, CAST(p_partkey * 31 % 5000 AS BIGINT) AS created_at,
                   CAST(p_partkey % 7 AS INT) AS hit_count, CAST(p_size * 10 AS INT) AS tokens_saved
            FROM part""",
        # one fetch for each order; the status follows from its key
        "fetches": f"""
            SELECT CAST(o_orderkey AS BIGINT) AS id, concat('d', CAST(o_custkey % 50 AS VARCHAR(20)), '.example.com') AS domain,
                   CAST({p(["200", "429", "503", "301", "404", "500", "200", "403"], "o_orderkey * 5 + o_custkey")} AS INT) AS status,
                   {p(["", "", "5", "abc", "", "12", "0"], "o_orderkey")} AS retry_after, {day("o_orderdate")} AS fetched_on
            FROM orders""",
        "calls": f"""
            SELECT CAST(o_orderkey AS BIGINT) AS id,
                   {p(["openai/gpt-4o-mini", "openai/gpt-4o", "openai/gpt-4o-2024-08-06", "anthropic/claude-3.5-sonnet", "anthropic/claude-3-haiku", "google/gemini-flash-1.5", "local/other"], "o_orderkey")} AS model,
                   CAST(o_custkey AS BIGINT) AS prompt_tokens, CAST(o_custkey % 77 AS BIGINT) AS completion_tokens,
                   CASE WHEN o_orderkey % 5 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reported_usd,
                   CAST(o_custkey % 60 AS DOUBLE) / 8 AS seconds
            FROM orders""",
        "page_urls": "SELECT page_id, url FROM pages",
    }


_BASE = ("lineitem", "supplier", "customer", "orders", "part", "pages")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = relation_sql("spark")[name]
    source = next(t for t in _BASE if f"FROM {t}" in sql)
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_relations(sql: str, *names: str) -> str:
    """DuckDB: the query with the relations it names as common table expressions."""
    all_sql = relation_sql("duckdb")
    return "WITH " + ",\n".join(f"{n} AS ({all_sql[n]})" for n in names) + "\n" + sql

"""Sources: landed pages, API answers, sitemaps and robots files, state tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.postings import first_of_each

#: Tables of the catalog, as Spark spells their types.
SCHEMAS = {
    "sites": "id bigint, domain string, name string, description string, created_at timestamp_ntz, last_scanned_at timestamp_ntz",
    "career_urls": "id bigint, site_id bigint, url string, platform string, is_active boolean, fail_count int, suspicious_count int, last_success_at timestamp_ntz, last_fail_at timestamp_ntz, created_at timestamp_ntz",
    "jobs": (
        "id bigint, site_id bigint, external_id string, title string, title_en string, company string, location string, url string, description string, "
        "salary_from int, salary_to int, salary_currency string, experience string, employment_type string, skills array<string>, extraction_method string, "
        "extraction_details struct<confidence: double, source_url: string, platform: string, attempts: array<string>>, "
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, is_active boolean"
    ),
    "job_history": "id bigint, job_id bigint, event string, changed_at timestamp_ntz, details string",
    "llm_cache": "key string, namespace string, value string, model string, ttl_seconds int, created_at timestamp_ntz, hit_count int, tokens_saved int",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """SC1: a state table under its fixed schema; columns that older files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def migrated(df: DataFrame, name: str) -> DataFrame:
    """The same rows under the current schema; running it again changes nothing."""
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])])


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """SC5, SC6: fetched pages as whole text files, their path as key."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def api_payloads(spark: SparkSession, path: str) -> DataFrame:
    """SC7, SC11: API answers, one JSON text for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("site_url"), F.col("value").alias("body"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """SC12: the sitemaps that robots files (url, body) name, in order."""
    lines = robots.select("url", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    hits = lines.where(F.col("line").rlike("(?i)^\\s*sitemap:"))
    return hits.select("url", "pos", F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("sitemap"))


#: Limits of a site's sitemaps (fixed values).
MAX_SITEMAP_URLS, MAX_LOCATIONS, MAX_CHILDREN = 300, 3, 2
_SITEMAP = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>, _broken string"
_XML = {"rowTag": "urlset", "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def sitemap_urls(sitemaps: DataFrame, limit: int = MAX_SITEMAP_URLS) -> DataFrame:
    """SC13, SC14: the addresses of sitemaps (url, xml), the first ``limit`` of each.

    Sitemaps are read as XML: whatever the namespace, comments and elements of
    other kinds don't count, CDATA and entities do.  An index gives its
    sitemaps.  Text that isn't a sitemap, or broken, gives no rows.  The limit
    is the feature: it bounds what one site can add.
    """
    looks = F.col("xml").rlike(r"(?is)^\s*(<\?xml|<(\w+:)?(urlset|sitemapindex)\b)")
    rows = sitemaps.where(looks).select("url", F.from_xml(F.trim("xml"), F.lit(_SITEMAP), _XML).alias("x")).where("x._broken is null")
    given = lambda c: F.filter(F.transform(F.coalesce(f"x.{c}", F.array().cast("array<struct<loc: string>>")), lambda e: F.trim(e["loc"])), lambda v: v != "")
    index = F.size(given("sitemap")) > 0
    rows = rows.select("url", index.alias("is_index"), F.posexplode(F.when(index, given("sitemap")).otherwise(given("url"))).alias("pos", "loc"))
    return rows.where(F.col("pos") < limit)


def site_urls(locations: DataFrame, sitemaps: DataFrame, limit: int = MAX_SITEMAP_URLS) -> DataFrame:
    """SC13: the addresses of each site, from the first of its locations that gives any.

    locations: site, ord, url; sitemaps: url, xml.  The first three locations
    count; an index stands for its first two children.
    """
    locs = sitemap_urls(sitemaps, 2**31 - 1)
    tried = locations.where(F.col("ord") < MAX_LOCATIONS).select("site", "ord", F.col("url").alias("at"))
    first = tried.join(locs, F.col("at") == locs["url"]).select("site", "ord", "is_index", "pos", "loc")
    plain = first.where("not is_index").select("site", "ord", F.lit(0).alias("child"), "pos", "loc")
    children = first.where(F.col("is_index") & (F.col("pos") < MAX_CHILDREN)).select("site", "ord", F.col("pos").alias("child"), F.col("loc").alias("at"))
    inner = locs.select("url", F.col("pos"), "loc")
    nested = children.join(inner, F.col("at") == F.col("url")).select("site", "ord", "child", "pos", "loc")
    rows = plain.unionByName(nested)
    best = rows.groupBy("site").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("child", "pos")) - 1
    return rows.join(best, ["site", "ord"]).select("site", place.alias("pos"), "loc").where(F.col("pos") < limit)


@dataclass(frozen=True)
class Settings:
    """SC15: typed settings, read from ``jobstrata.*`` keys of the session."""

    request_delay: float = 0.5
    concurrency: int = 2
    max_pages: int = 3
    max_sitemap_urls: int = 300
    cache_ttl_jobs: int = 6 * 3600
    cache_ttl_translation: int = 30 * 86400
    cache_ttl_urls: int = 7 * 86400
    cache_ttl_company: int = 30 * 86400
    model: str = "openai/gpt-4o-mini"
    location: str = "Moscow"
    keywords: str = "Python Developer"
    output_format: str = "json"
    output_dir: str = "./data"
    provider: str = "openrouter"
    rate_limit: bool = True

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        got = {f.name: spark.conf.get(f"jobstrata.{f.name}", None) for f in fields(cls)}
        typed = lambda k, v: v.lower() in ("1", "true", "yes") if isinstance(getattr(cls, k), bool) else type(getattr(cls, k))(v)
        return cls(**{k: typed(k, v) for k, v in got.items() if v is not None})


def newest_pages(fetches: DataFrame) -> DataFrame:
    """The last landed version of each page (url, fetched_at, html)."""
    return first_of_each(fetches, ["url"], [F.expr("-unix_micros(cast(fetched_at as timestamp))").alias("o")])

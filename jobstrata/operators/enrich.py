"""What is added to sites and pages from answers computed elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import upserted

_EMPTY = "coalesce(description, '') = ''"


def company_info(sites: DataFrame, answers: DataFrame) -> DataFrame:
    """Sites (id, domain, description ...) without a description get that of
    the answers (domain, description), if there is one."""
    fresh = answers.where("coalesce(description, '') <> ''").groupBy("domain").agg(F.min("description").alias("__fresh"))
    wanting = sites.where(_EMPTY).join(fresh, "domain", "left").withColumn("description", F.coalesce("__fresh", "description"))
    return sites.where(f"not ({_EMPTY})").unionByName(wanting.select(*sites.columns))


def company_info_of_pages(sites: DataFrame, answers: DataFrame, new_id: Column) -> DataFrame:
    """The same, and sites that aren't known yet are created, also by an
    empty answer; ``new_id`` is made of ``new.domain``."""
    fresh = answers.groupBy("domain").agg(F.min(F.nullif("description", F.lit(""))).alias("description"))
    keep = F.when(F.coalesce("old.description", F.lit("")) == "", F.coalesce(F.nullif("new.description", F.lit("")), F.col("old.description"))).otherwise(F.col("old.description"))
    return upserted(sites, fresh, ["domain"], {"description": keep}, {"id": new_id, "name": F.col("new.domain")})


def created_sites(sites: DataFrame, wanted: DataFrame, now: Column, new_id: Column | None = None) -> DataFrame:
    """The sites table with a row for each wanted domain (domain, name) that it lacks.

    A domain wanted more than once is made once, under its smallest name; one
    without a name is called by its domain.  Domains that are null are passed
    over.  ``new_id``, of ``domain``, is a hash if none is given.
    """
    fresh = wanted.where("domain is not null").groupBy("domain").agg(F.min(F.nullif("name", F.lit(""))).alias("name"))
    fresh = fresh.join(sites.select("domain"), "domain", "left_anti")
    made = {"id": F.xxhash64("domain") if new_id is None else new_id, "domain": F.col("domain"), "name": F.coalesce("name", "domain"), "created_at": now}
    return sites.unionByName(fresh.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sites.schema]))


def at_boards(pages: DataFrame, boards: DataFrame, landed: DataFrame) -> DataFrame:
    """Pages without a platform whose board has been fetched become the
    board's page.

    pages: page_id, url, html, platform; boards (X18): page_id, platform,
    board_url; landed: url, html.  ``external`` says which were replaced.
    """
    b = boards.join(landed.select(F.col("url").alias("board_url"), F.col("html").alias("__html")), "board_url").select("page_id", "board_url", F.col("platform").alias("__platform"), "__html")
    rows = pages.join(b, "page_id", "left").withColumn("external", F.col("platform").isNull() & F.col("__html").isNotNull())
    pick = lambda new, old: F.when(F.col("external"), F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select("page_id", pick("board_url", "url"), pick("__html", "html"), pick("__platform", "platform"), "external")

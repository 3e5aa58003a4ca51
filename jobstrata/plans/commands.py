"""What a user asks for by name: searches, listings, exports.

Each takes tables or folders of what was landed and gives the table that is
shown; ``saved`` writes it as one JSON array or as CSV.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract
from ..sources import json_export, searchers, sinks
from ..sources.files import Settings

#: Where postings can be searched for (fixed values).
SOURCES = [("hh.ru", "search", "RU"), ("stepstone.de", "stepstone", "DE"), ("karriere.at", "karriere", "AT"), ("website", "website", None)]


def info(spark: SparkSession) -> DataFrame:
    """Sources, the command of each, and its country."""
    return spark.createDataFrame(SOURCES, "source string, command string, country string")


def search(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """Postings of landed answers (body) of a search by interface, at most ``limit``, which is what the user asks for."""
    rows = extract.vacancies(payloads)
    return rows if limit is None else rows.limit(limit)


def _said(spark: SparkSession, made: Column) -> str:
    return spark.range(1).select(made).first()[0]


def _listed(spark: SparkSession, site: str, cities: dict[str, str], folder: str, keywords: str | None, location: str | None, page: int) -> DataFrame:
    searchers.register(spark)
    options = {"first_page": page, "last_page": page, "keywords": json.dumps([_said(spark, text.slug(F.lit(keywords or Settings.of(spark).keywords)))])}
    if location:
        options["place"] = _said(spark, text.location_slug(F.lit(location), cities))
    rows = spark.read.format(site).options(**options).load(folder)
    return rows.select(F.concat(F.lit(f"{site}-"), "pos").alias("id"), "title", "company", "location", "url", "source", "pos")


def stepstone(spark: SparkSession, folder: str, keywords: str | None = None, location: str | None = None, page: int = 0) -> DataFrame:
    """Postings of one landed page of results, as SC9 reads them."""
    return _listed(spark, "stepstone", text.CITIES_DE, folder, keywords, location, page)


def karriere(spark: SparkSession, folder: str, keywords: str | None = None, location: str | None = None, page: int = 0) -> DataFrame:
    """The same for SC10."""
    return _listed(spark, "karriere", text.CITIES_AT, folder, keywords, location, page)


def find_job_urls(answers: DataFrame) -> DataFrame:
    """Addresses of postings that answers (page_id, url, answer) name, in their order."""
    return extract.answer_urls(answers)


def saved(jobs: DataFrame, path: str, kind: str = "json") -> None:
    """SK1 or SK2; other kinds are an error."""
    if kind == "json":
        json_export.export_json(jobs, path)
    elif kind == "csv":
        sinks.export_csv(jobs, path)
    else:
        raise ValueError(f"json or csv, not {kind}")

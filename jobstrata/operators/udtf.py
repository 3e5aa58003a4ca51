"""Parsers as table functions of SQL.

``register`` makes ``parse_postings(html, url, platform)`` known to a session,
for ``LATERAL`` use beside any table of pages.  Which parser a platform has is
a table of its own, to which a user may add before registering.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .dom import Node, parse
from .extract import PARSERS, POSTING, json_ld, microdata

Parser = Callable[[Node, str], list[dict]]


class Registry:
    """Platform -> parser; pages without a platform are read for structured data."""

    def __init__(self, parsers: dict[str, Parser] | None = None):
        self.parsers = dict(PARSERS if parsers is None else parsers)

    def add(self, platform: str, parser: Parser) -> Registry:
        self.parsers[platform] = parser
        return self

    def postings(self, html: str | None, url: str | None, platform: str | None) -> list[dict]:
        """Postings of a page; a platform that isn't known has none, nor has a page without text."""
        if not html:
            return []
        tree, base = parse(html), url or ""
        if platform is None:
            return json_ld(tree, base) or microdata(tree, base)
        return self.parsers[platform](tree, base) if platform in self.parsers else []

    def register(self, spark: SparkSession, name: str = "parse_postings") -> None:
        """SQL: ``SELECT ... FROM pages, LATERAL parse_postings(html, url, platform)``."""
        registry = self

        class Postings:
            def eval(self, html: str, url: str, platform: str) -> Iterator[tuple]:
                for pos, p in enumerate(registry.postings(html, url, platform)):
                    yield (pos, *(p[c] for c in ("title", "location", "url", "department", "company")))

        spark.udtf.register(name, udtf(Postings, returnType=f"pos int, {POSTING}"))

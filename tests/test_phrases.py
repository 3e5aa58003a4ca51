"""Tables of rules against joins and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from jobstrata.operators import enrich, phrases, postings
from jobstrata.plans import commands
from jobstrata.sources import files


def test_fifty_thousand_phrases(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 5)))
    table = spark.createDataFrame([(k, f"{word()} {word()}", f"v{k}") for k in range(50_000)], "ordinal long, phrase string, value string")
    texts = spark.createDataFrame([(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(120)] + [(500, None), (501, "")], "id long, text string")
    want = {x.id: x.o for x in texts.join(F.broadcast(table), F.contains("text", "phrase"), "left").groupBy("id").agg(F.min("ordinal").alias("o")).collect()}
    got = phrases.first_phrase(texts, table, "text").collect()
    assert {x.id: x.ordinal for x in got} == want and all(x.value == (None if x.ordinal is None else f"v{x.ordinal}") for x in got)
    assert sum(o is not None for o in want.values()) > 50
    # a table beyond the limit is tried in ranges, and nothing changes
    assert len(phrases._chunks(table, 150_000)) > 3
    few = phrases.first_phrase(texts, table, "text", limit=150_000)
    assert {x.id: x.ordinal for x in few.collect()} == want


def test_odd_phrases(spark):
    table = spark.createDataFrame([(3, "b", "x"), (1, None, "n"), (2, "", "e"), (5, "b", "y"), (4, "bb", "z")], "ordinal long, phrase string, value string")
    texts = spark.createDataFrame([(1, "abb"), (2, "a"), (3, None)], "id long, text string")
    assert sorted((r.id, r.ordinal, r.value) for r in phrases.first_phrase(texts, table, "text").collect()) == [(1, 3, "x"), (2, None, None), (3, None, None)]
    assert [r.ordinal for r in phrases.first_phrase(texts, table.where("false"), "text").collect()] == [None] * 3


@pytest.mark.parametrize(
    "host, registered",
    [
        ("www.acme.co.uk", "acme.co.uk"), ("co.uk", None), ("Acme.COM.", "acme.com"), ("a.b.c.ck", "b.c.ck"), ("c.ck", None), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"),
        ("x.y.unknown", "y.unknown"), ("unknown", None), ("10.0.0.1", None), ("[::1]", None), ("shop.größe.例え", "größe.例え"), ("a.b.公司.cn", "b.公司.cn"), (None, None), ("", None),
    ],
)
def test_public_suffixes(spark, host, registered):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("例え",), ("cn",), ("公司.cn",), (None,)], "rule string")
    df = spark.createDataFrame([(host,)], "host string")
    assert [r.registered for r in phrases.registered_domains(df, rules).collect()] == [registered]


def test_groups_with_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a", 0), (2, 5, "a", 0), (3, 5, "b", None), (4, None, "b", 1)], "id long, site long, title string, pos long")
    some = postings.keep_matching_or_all(df, F.col("title") == "a", ["site"])
    assert sorted(r.id for r in some.collect()) == [1, 2]
    none = postings.keep_matching_or_all(df, F.lit(None).cast("boolean"), ["site"])
    assert sorted(r.id for r in none.collect()) == [1, 2, 3, 4]
    rows = postings.records(df, F.lit("https://x.de"), F.lit("c"), ["pos", "id"], ["site"], keep=["id"])
    assert {r.id: r.external_id for r in rows.collect()} == {1: "web-x.de-0", 4: "web-x.de-1", 3: "web-x.de-0", 2: "web-x.de-1"}
    top = postings.sitemap_candidates(df, F.lit(False), ["site"], [F.col("id")])
    assert top.count() == 4


def test_headings_in_blocks(spark):
    r = random.Random(5)
    rows = [(k, r.choice([None, 1, 2]), r.choice([None, None, None, f"h{k}"])) for k in range(300)]
    last, want = {}, {}
    for k, g, h in rows:
        last[g] = h or last.get(g)
        want[k] = last[g]
    df = spark.createDataFrame(rows, "id long, g long, h string")
    for block in (1, 7, 1000):
        assert {x.id: x.heading for x in postings.with_running_heading(df, ["g"], "id", "h", "heading", block).collect()} == want


def test_an_empty_answer_hides_no_good_one(spark):
    sites = spark.createDataFrame([(1, "a", "A", None)], "id long, domain string, name string, description string")
    answers = spark.createDataFrame([("a", ""), ("a", "about a"), ("b", ""), ("c", None)], "domain string, description string")
    got = {r.domain: r.description for r in enrich.company_info_of_pages(sites, answers, F.xxhash64("new.domain")).collect()}
    assert got == {"a": "about a", "b": None, "c": None}
    made = enrich.created_sites(sites.withColumn("created_at", F.lit(1)), spark.createDataFrame([("a", "x"), ("b", ""), ("b", "B"), ("c", None), (None, "n")], "domain string, name string"), F.lit(9))
    assert sorted((r.domain, r.name, r.created_at) for r in made.collect()) == [("a", "A", 1), ("b", "B", 9), ("c", "c", 9)]


SITEMAPS = [
    '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- <url><loc>no</loc></url> --><url><loc> https://a/1 </loc></url><url><loc><![CDATA[https://a/2?x=1&y=2]]></loc></url></urlset>',
    '<sm:urlset xmlns:sm="http://s" xmlns:i="http://i"><sm:url><sm:loc>https://a/3?a=1&amp;b=&#39;x&#39;</sm:loc><i:image><i:loc>img</i:loc></i:image></sm:url><sm:url><sm:loc/></sm:url></sm:urlset>',
    "<sitemapindex><sitemap><loc>https://s/1.xml</loc></sitemap><sitemap><lastmod>1</lastmod></sitemap></sitemapindex>",
    "<urlset><url><loc>https://a/4</loc></url><url><loc>broken", "<html><loc>no</loc></html>", None, "", "<urlset></urlset>",
    '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><urlset><url><loc>&x;</loc></url></urlset>',
]


def test_sitemaps_are_read_as_xml(spark):
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(SITEMAPS)], "url string, xml string")
    got = sorted(tuple(r) for r in files.sitemap_urls(df).collect())
    assert got == [("0", False, 0, "https://a/1"), ("0", False, 1, "https://a/2?x=1&y=2"), ("1", False, 0, "https://a/3?a=1&b='x'"), ("2", True, 0, "https://s/1.xml")]
    assert files.sitemap_urls(df, 1).count() == 3


def test_crawls_end(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "gone"), ("d", None), ("e", ""), ("f", "g"), ("g", "h"), ("h", "i"), ("i", None)], "url string, next_page_url string")
    starts = spark.createDataFrame([(k, u) for k, u in enumerate(["a", "c", "d", "e", "f", "nowhere", "b", "f"])], "site_id long, url string")
    got = {}
    for r in postings.followed_pages(starts, pages).orderBy("page_no").collect():
        got.setdefault(r.site_id, []).append(r.url)
    assert got == {0: ["a", "b", "a"], 1: ["c"], 2: ["d"], 3: ["e"], 4: ["f", "g", "h"], 6: ["b", "a", "b"], 7: ["f", "g", "h"]}


def test_translations_of_unequal_length(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, ["a"], ["x", "y"]), (3, [], ["x"]), (4, None, None), (5, ["a"], None)], "id long, titles array<string>, translations array<string>")
    assert sorted(tuple(r) for r in postings.with_translations(df).collect()) == [(1, 0, "a", "x"), (1, 1, "b", None), (2, 0, "a", "x"), (5, 0, "a", None)]


def test_commands(spark, tmp_path):
    at = tmp_path / "keyword=data-analyst" / "place=muenchen" / "page=1"
    at.mkdir(parents=True)
    (at / "a.html").write_text('<article data-at="job-item"><h2>Data Analyst</h2><a href="/x--7">l</a></article>')
    rows = commands.stepstone(spark, str(tmp_path), "Data Analyst", "München", 1)
    assert [(r.id, r.title, r.source) for r in rows.collect()] == [("stepstone-0", "Data Analyst", "stepstone.de")]
    assert commands.stepstone(spark, str(tmp_path), "Data Analyst", "Berlin", 1).count() == 0 and commands.karriere(spark, str(tmp_path), "Data Analyst").count() == 0
    body = '{"items":[{"id":"1","name":"Dev","alternate_url":"u"},{"id":"2","name":"QA","alternate_url":"v"}]}'
    payloads = spark.createDataFrame([(body,)], "body string")
    assert commands.search(payloads).count() == 2 and commands.search(payloads, 1).count() == 1
    commands.saved(commands.search(payloads), str(tmp_path / "out.json"))
    assert '"title": "Dev"' in (tmp_path / "out.json").read_text() and '"salary_display"' in (tmp_path / "out.json").read_text()
    with pytest.raises(ValueError, match="json or csv"):
        commands.saved(rows, str(tmp_path / "x"), "xml")
    assert {r.command for r in commands.info(spark).collect()} >= {"search", "stepstone", "karriere", "website"}
    urls = commands.find_job_urls(spark.createDataFrame([(1, "https://a/b", '["c", "d"]')], "page_id long, url string, answer string"))
    assert [r.url for r in urls.collect()] == ["https://a/c", "https://a/d"]


def test_postings_of_one_company_meet_in_no_task(spark):
    """nothing is dealt by the address a page was reached from."""
    rows = [(k, k % 40, "Dev" if k % 3 else "Dev at 2R Software", None, None) for k in range(200)] + [(900, 41, "Dev", None, None), (901, 41, "x 2rsoftware", "y", None)]
    df = spark.createDataFrame(rows, "id long, site long, title string, location string, company string")
    got = postings.by_source_company(df, F.when(F.col("site") != 39, "https://www.2rsoftware.de/"), ["site"])
    named = lambda r: "2r software" in r[2].lower() or "2rsoftware" in r[2]
    some = {r[1] for r in rows if named(r) and r[1] != 39}
    assert {r.id for r in got.collect()} == {r[0] for r in rows if r[1] not in some or named(r)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1

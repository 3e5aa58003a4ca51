import datetime

import pytest
from pyspark.sql import functions as F

from jobstrata.functions import text, urls
from jobstrata.operators import extract, markup, postings, reports, state
from jobstrata.operators.dom import parse
from jobstrata.plans import write_path
from jobstrata.sources import files, sinks
from jobstrata.streaming import crawl


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def test_titles_and_locations(spark):
    t, c = F.col("t"), "t"
    assert one(spark, text.normalize_title(t), **{c: " Dev (m/w/d)  Lead m/w "}) == "dev lead"
    assert one(spark, text.normalize_location(t), **{c: "Berlin, Germany"}) == "berlin"
    # each suffix is tried once and in order
    assert one(spark, text.sync_location(t), **{c: "Berlin, Germany, Remote"}) == "berlin, germany"
    assert one(spark, text.sync_location(t), **{c: "Remote"}) == "remote" or one(spark, text.sync_location(t), **{c: "Remote"}) == ""
    assert one(spark, text.sync_location(t), **{c: "Unknown"}) == ""
    assert one(spark, text.unrepeated(t), **{c: "Backend DevBackend Dev"}) == "Backend Dev"
    assert one(spark, text.filename_title(t), **{c: "stellenausschreibung_it-systemadministrator_v2_20251027.pdf"}) == "IT-Systemadministrator"
    assert one(spark, text.slug(t), **{c: "Köln & Straße!"}) == "koeln-strasse"


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.platform(u), u="https://x.jobs.personio.de/job/1") == "personio"
    assert one(spark, urls.board_url(u, urls.platform(u)), u="https://boards.greenhouse.io/acme/jobs/1") == "https://boards.greenhouse.io/acme"
    assert one(spark, urls.variants(u), u="https://a.b/job.html") == ["https://a.b/job.html", "https://a.b/jobs.html"]
    assert one(spark, urls.bare_host(u), u="mywww.x") == "mywww.x"
    assert one(spark, urls.search_term(u), u="https://a/?q=data+x") == "data x"


def scan(spark, rows):
    return spark.createDataFrame(rows, "site_id long, title string, location string, pos long")


NEW_ID = "its own"


def test_reconcile_lifecycle(spark):
    stored = spark.createDataFrame(
        [(1, 1, "Dev (m/w/d)", "Berlin", True), (2, 1, "QA", None, False), (3, 1, "Ops", "Wien", True), (4, 1, "Old", "Wien", False)],
        "id long, site_id long, title string, location string, is_active boolean",
    )
    new = scan(spark, [(1, "dev", "Berlin, Germany", 0), (1, "QA", "Unknown", 1), (1, "New", "Graz", 2), (1, "NEW", "Graz", 3)])
    got = {(r.k_title, NEW_ID if r.event == "added" else r.job_id): r.event for r in postings.reconciled(stored, new).collect()}
    assert got == {("dev", 1): "seen", ("qa", 2): "reactivated", ("ops", 3): "removed", ("new", NEW_ID): "added", ("old", 4): None}
    history = {r.event: r.details for r in postings.history_events(postings.reconciled(stored, new)).collect()}
    assert history["removed"] == "Job no longer found on site" and history["added"] is None
    with_time = stored.withColumn("last_seen_at", F.lit(0).cast("long"))
    state_rows = postings.next_state(with_time, postings.reconciled(stored, new), F.lit(9).cast("long")).collect()
    assert len(state_rows) == 5 and {r.id: r.is_active for r in state_rows if r.id in (1, 2, 3, 4)} == {1: True, 2: True, 3: False, 4: False}


def test_guard(spark):
    f = lambda a, b: one(spark, postings.suspicious(F.lit(a), F.lit(b)))
    assert f(6, 2) and not f(6, 3) and not f(5, 0)


def test_rate_limit_fold_is_the_streaming_step(spark):
    rows = [(1, "a", 429, ""), (2, "a", 429, "7"), (3, "a", 404, ""), (4, "a", 200, ""), (5, "a", 503, "0"), (6, "b", 200, "")]
    df = spark.createDataFrame(rows, "id long, domain string, status int, retry_after string")
    got = {r.domain: r.delay for r in state.delays(df).collect()}
    want = {}
    for _, d, s, w in rows:
        want[d] = crawl.step(0, want.get(d, 0.5), s, float(w) if w.isdigit() and int(w) else None)[1]
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_breaker(spark):
    rows = [(1, "a", 500), (2, "a", 500), (3, "a", 500), (4, "a", 200), (5, "a", 404), (6, "b", 404)]
    got = {r.domain: (r.fail_count, r.is_active) for r in state.breaker(spark.createDataFrame(rows, "id long, domain string, status int")).collect()}
    assert got == {"a": (1, True), "b": (1, True)}
    assert {r.domain: r.is_active for r in state.breaker(spark.createDataFrame(rows[:3] + [(7, "c", 200), (8, "c", 500), (9, "c", 404), (10, "c", 503)], "id long, domain string, status int")).collect()} == {"a": False, "c": False}


def test_untidy_html():
    root = parse("<div><p>a<p>b<li>x<li>y</div><b>z")
    assert [x.text() for x in root.select("p")][:1] == ["a"]
    assert parse(None).text() == "" and parse("<" * 5).text() is not None
    deep = "<div>" * 3000 + "t" + "</div>" * 3000
    assert parse(deep).text() == "t" and "t" in markup.clean(deep)


PAGES = {
    "greenhouse": ("https://boards.greenhouse.io/a", '<section><h3>Eng</h3><a href="/a/jobs/1"><p>Dev New</p><p>Berlin</p></a></section><section><h3>Ops</h3><a href="/a/jobs/2">Admin - Wien</a></section>', [("Dev", "Berlin", "Eng"), ("Admin", "Wien", "Ops")]),
    "hibob": ("https://a.careers.hibob.com", "<b-virtual-scroll-list-item><b-heading>QA (m/w/d)</b-heading><div>IT · Remote Germany · Full-time</div></b-virtual-scroll-list-item>", [("QA (m/w/d)", "Germany, Remote", "IT")]),
    "hrworks": ("https://h", '<div class="portlet"><a class="job-offer-content" href="/x?id=1"><h2>Dev</h2></a><div class="margin-top-10">IT - Vollzeit</div><a><i class="icomoon-location"></i><span>Linz</span></a></div>', [("Dev", "Linz", "IT")]),
    "softgarden": ("https://a.softgarden.io", '<li><a href="/job/1">Dev (all genders) – Jetzt bewerben!</a><span class="location">Graz</span></li><a href="/job/?page=2">next</a>', [("Dev", "Graz", None)]),
    "join": ("https://join.com/companies/a", '<article class="job-x"><a href="/companies/a/jobs/1"><h3>New York Clerk</h3></a><span class="city">Ulm</span></article>', [("New York Clerk", "Ulm", None)]),
    "workable": ("https://apply.workable.com/a", '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","jobLocation":{"address":{"addressLocality":"Athens","addressCountry":{"name":"Greece"}}}}</script>', [("Dev", "Athens, Greece", None)]),
    "recruitee": ("https://a.recruitee.com", '<script>x = {"offers": [{"title":"Dev","city":"Bonn","careers_url":"https://y"}], "z":1}</script>', [("Dev", "Bonn", None)]),
    "deloitte": ("https://job.deloitte.com/search?search=data", '<div>Berlin <a href="/job-data_1">Data Analyst</a><a href="/job-x_2">Clerk here</a></div>', [("Data Analyst", "Berlin", None)]),
    "stepstone": ("https://www.stepstone.de", '<article data-at="job-item"><h2>Dev</h2><a href="/x--1">l</a><span data-at="job-item-company-name">Acme</span></article>', [("Dev", "Germany", None)]),
    "odoo": ("https://o", '<div class="card card-default"><a href="/jobs/detail/1"><h3>Dev</h3></a><span>Hauptsitz Köln</span></div>', [("Dev", "Hauptsitz Köln", None)]),
    "karriere": ("https://www.karriere.at", '<a href="/jobs/123">Software Developer</a><a href="/x">Software Tester</a>', [("Software Developer", "Austria", None)]),
}


def test_platforms(spark):
    names = list(PAGES)
    df = spark.createDataFrame([(k, PAGES[n][0], PAGES[n][1], n) for k, n in enumerate(names)], "page_id long, url string, html string, platform string")
    got = {}
    for r in extract.extracted(df).orderBy("page_id", "pos").collect():
        got.setdefault(names[r.page_id], []).append((r.title, r.location, r.department))
    assert got == {n: p[2] for n, p in PAGES.items()}


def test_empty_and_broken_pages(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "u", "", "lever"), (3, "u", '<script type="application/ld+json">{bad</script>', None), (4, "u", "<p>x", "ashby")], "page_id long, url string, html string, platform string")
    assert extract.extracted(df).count() == 0


def test_markdown():
    md = markup.markdown("<nav>menu</nav><h2>Jobs</h2><ul><li>Dev <a href='/a'>apply</a></li></ul><p>Impressum</p><table><tr><td>a</td><td>b</td></tr></table>")
    assert md.split("\n") == ["## Jobs", "- Dev [apply](/a)", "a | b"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"]), (2, None)], "id long, skills array<string>")
    sinks.export_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    root = str(tmp_path / "t")
    assert sinks.latest_version(spark, root) is None
    for v in (1, 2):
        sinks.save_version(df, root, v)
    assert sinks.latest_version(spark, root).endswith("v00000002")
    old = spark.createDataFrame([("k", "ns")], "key string, namespace string")
    assert files.migrated(files.migrated(old, "llm_cache"), "llm_cache").first().hit_count is None
    assert files.sitemap_urls(spark.createDataFrame([("u", "not xml"), ("v", None)], "url string, xml string")).count() == 0
    assert files.Settings.of(spark).max_pages == 3


def test_stream_of_fetches(spark, tmp_path):
    src = str(tmp_path / "in")
    noon = datetime.datetime(2024, 5, 1, 12)
    waits = ["3", "Wed, 01 May 2024 12:00:09 GMT", "Wed, 01 May 2024 11:00:00 GMT", "", "", "", ""]
    rows = [(k, f"d{k % 3}", [200, 429, 500][k % 2 + (k % 5 == 0)], waits[k % 7], noon) for k in range(60)]
    schema = "id long, domain string, status int, retry_after string, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = crawl.domain_state(spark.readStream.schema(schema).parquet(src))
    q = stream.writeStream.outputMode("update").format("memory").queryName("domains").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.domain: round(r.delay, 6) for r in spark.table("domains").collect()}
    want = {r.domain: r.delay for r in state.delays(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_workable_cards():
    page = parse('<ul><li class="job"><a href="/a/j/1">QA Engineer</a> Remote Cluj, Romania All, QA Full time</li><li><a href="/a/j/1">again</a></li></ul>')
    got = extract.PARSERS["workable"](page, "https://apply.workable.com/a")
    assert [(p["title"], p["location"], p["department"]) for p in got] == [("QA Engineer", "Cluj, Romania", "QA")]


def test_card_parts():
    assert extract.card_parts("Data Engineer Hybrid Athens, Greece All, Engineering Full time") == ("Data Engineer", "Athens, Greece", "Engineering")
    assert extract.card_parts("Clerk") == ("Clerk", None, None)


def test_microdata():
    page = parse('<div itemtype="https://schema.org/JobPosting"><b itemprop="title">Dev</b><a itemprop="url" href="/j"></a><i itemprop="jobLocation"><u itemprop="addressLocality">Graz</u></i></div>')
    assert [(p["title"], p["location"], p["url"]) for p in extract.microdata(page, "https://a.b/c")] == [("Dev", "Graz", "https://a.b/j")]


JOB = "id long, site_id long, title string, location string, url string, company string, is_active boolean, first_seen_at long, last_seen_at long"


def test_next_state_keeps_and_adds_whole_rows(spark):
    stored = spark.createDataFrame([(1, 1, "Dev", "Graz, Austria", "u1", "Acme", True, 3, 4), (2, 1, "Gone", "Wien", "u2", "Acme", True, 3, 4)], JOB)
    new = spark.createDataFrame([(1, 0, "DEV (m/w/d)", "Graz", "v1", "Other"), (1, 1, "New", "Graz, Austria", "v2", "Other")], "site_id long, pos long, title string, location string, url string, company string")
    changes = postings.reconciled(stored, new)
    rows = {r.title: r for r in postings.next_state(stored, changes, F.lit(9).cast("long")).collect()}
    assert tuple(rows["Dev"]) == (1, 1, "Dev", "Graz, Austria", "u1", "Acme", True, 3, 9)
    assert tuple(rows["Gone"]) == (2, 1, "Gone", "Wien", "u2", "Acme", False, 3, 4)
    assert tuple(rows["New"])[1:] == (1, "New", "Graz, Austria", "v2", "Other", True, 9, 9)
    events = {r.event: r.job_id for r in postings.history_events(changes, F.lit(9)).collect()}
    assert events == {"removed": 2, "added": rows["New"].id}
    history = postings.history_events(changes).withColumnRenamed("job_id", "job").select(F.monotonically_increasing_id().alias("id"), F.col("job").alias("job_id"), "event", F.current_date().alias("changed_on"))
    after = postings.next_state(stored, changes, F.lit(9).cast("long"))
    sites = spark.createDataFrame([(1, "d")], "id long, domain string")
    assert {(r.event, r.title) for r in reports.latest_history(history, after, sites, 10).collect()} == {("added", "New"), ("removed", "Gone")}
    gone = postings.removed_postings(changes).first()
    assert (gone.id, gone.company, gone.location, gone.source) == ("cached-2", "Acme", "Wien", "cached:1")


def test_suspicious_scans_wait_for_confirmation(spark):
    jobs = spark.createDataFrame([(k, 1, f"Job {k}", "Wien", None, None, True, 0, 0) for k in range(10)], JOB)
    waiting = spark.createDataFrame([], "site_id long, suspicious_count int")
    scanned, few = spark.createDataFrame([(1,)], "site_id long"), scan(spark, [(1, "Job 1", "Wien", 0)])
    seen = []
    for turn in range(1, 4):
        step = write_path.apply_scan(jobs, waiting, scanned, few, F.lit(turn).cast("long"))
        gate = step.gate.first()
        seen.append((gate.allowed, gate.outcome, gate.suspicious_count, step.history.count()))
        jobs, waiting = spark.createDataFrame(step.jobs.collect(), JOB), spark.createDataFrame(step.waiting.collect(), "site_id long, suspicious_count int")
    assert seen == [(False, "suspicious", 1, 0), (False, "suspicious", 2, 0), (True, "success", 0, 9)]
    empty = few.limit(0)
    assert write_path.apply_scan(jobs, waiting, scanned, empty, F.lit(9).cast("long"), cached=True).gate.first().outcome == "failed"
    assert write_path.apply_scan(jobs, waiting, scanned, empty, F.lit(9).cast("long")).history.count() == 1


def test_marked_urls(spark):
    urls_ = spark.createDataFrame([(1, 2, 1, True, None), (2, 2, 1, True, None), (3, 0, 2, False, None)], "id long, fail_count int, suspicious_count int, is_active boolean, last_success_at long")
    got = state.marked(urls_, spark.createDataFrame([(1, "failed"), (2, "suspicious"), (3, "success")], "id long, outcome string"), F.lit(7).cast("long"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1, False, None), (2, 2, 2, True, None), (3, 0, 0, True, 7)]


SCAN = "site_id long, scan_id long, done boolean, pos long, title string, location string, url string"


def replay(spark, root, batches, again=()):
    run = crawl.reconcile_each_batch(root, lambda n: F.to_timestamp_ntz(F.lit(f"2024-01-{n:02d} 00:00:00")), buckets=16)
    for n, rows in enumerate(batches, 1):
        for _ in range(2 if n in again else 1):
            run(spark.createDataFrame(rows, SCAN), n)
    store = crawl.catalog_store(spark, root)
    jobs, history = store.read("jobs"), store.log("history", crawl.HISTORY)
    return {(r.site_id, r.title, r.is_active, str(r.last_seen_at)) for r in jobs.collect()}, sorted((r.site_id, r.event, str(r.changed_at)) for r in history.collect())


def test_stream_of_scans(spark, tmp_path):
    def row(site, scan_id, pos, title):
        return (site, scan_id, False, pos, title, "Wien", f"u{pos}")

    def done(site, scan_id):
        return (site, scan_id, True, None, None, None, None)

    few = [[row(1, 1, 0, "QA"), row(1, 1, 1, "Dev"), done(1, 1)], [row(1, 2, 0, "QA"), done(1, 2)], [row(2, 1, 0, "Ops"), done(2, 1)], [done(2, 2), row(1, 3, 0, "QA"), row(1, 3, 1, "Dev"), done(1, 3)]]
    jobs, events = replay(spark, str(tmp_path / "a"), few)
    assert {j[:3] for j in jobs} == {(1, "QA", True), (1, "Dev", True), (2, "Ops", False)}
    assert [e[:2] for e in events] == [(1, "added"), (1, "added"), (1, "reactivated"), (1, "removed"), (2, "added"), (2, "removed")]
    # a batch that is tried again changes nothing and adds nothing twice
    assert replay(spark, str(tmp_path / "b"), few, again=(1, 2, 4)) == (jobs, events)
    # a scan in parts waits until it is complete
    parts = [[row(1, 1, 0, "QA")], [row(1, 1, 1, "Dev"), done(1, 1)]]
    jobs, events = replay(spark, str(tmp_path / "c"), parts)
    assert {j[:3] for j in jobs} == {(1, "QA", True), (1, "Dev", True)} and [e[1] for e in events] == ["added", "added"]
    # two scans of a site in one batch go one after the other
    both = [[*few[0], *few[1]]]
    jobs, events = replay(spark, str(tmp_path / "d"), both)
    assert {j[:3] for j in jobs} == {(1, "QA", True), (1, "Dev", False)} and len(events) == 3


def test_answers(spark):
    said = lambda x: one(spark, text.answer_json(F.col("t")), t=x)
    assert said('x {"jobs": [1]} and {bad}') == '{"jobs": [1]}'
    assert said("```json\n{\"a\": 1}\n```") == '{"a": 1}' and said(None) == said("") == said("{") == "[]"
    assert said('{"a": "}"} x') == "[]" and said("see [1, 2] ok") == "[1, 2]"


def test_links_of_a_page(spark):
    html = '<a href=" #top">t</a><a href="/a">one</a><a href="/a">two</a><a href="javascript:x()">j</a><script>f("https://acme.recruitee.com/o/x", \'https://boards.greenhouse.io/acme/jobs/1\')</script>'
    rows = extract.links(spark.createDataFrame([(1, "https://b.c/d", html), (2, None, None)], "page_id long, url string, html string"))
    assert [r.label for r in extract.distinct_links(rows).collect()] == ["https://b.c/a [one]"]
    board = extract.external_boards(rows).first()
    assert (board.platform, board.board_url) == ("greenhouse", "https://boards.greenhouse.io/acme")


def test_answer_urls_of_anything(spark):
    rows = [(1, "https://a/b", '{"no": "list"}'), (2, "https://a/b", "[1, null, [\"x\"]]"), (3, "https://a/b", None), (4, "https://a/b", "bad"), (5, "https://a/b", '["c", "c"]')]
    got = extract.answer_urls(spark.createDataFrame(rows, "page_id long, url string, answer string")).collect()
    assert [tuple(r) for r in got] == [(5, 0, "https://a/c")]


def test_five_hundred_postings_of_one_page(spark):
    graph = ",".join(f'{{"@type":"JobPosting","title":"Job {k}"}}' for k in range(500))
    page = spark.createDataFrame([(1, "https://a/b", f'<script type="application/ld+json">{{"@graph":[{graph}]}}</script>', None)], "page_id long, url string, html string, platform string")
    assert [(r.pos, r.title) for r in extract.extracted(page).orderBy("pos").collect()] == [(k, f"Job {k}") for k in range(500)]


def test_read_table_and_landed_files(spark, tmp_path):
    spark.createDataFrame([("k", "ns")], "key string, namespace string").write.parquet(str(tmp_path / "c"))
    got = files.read_table(spark, str(tmp_path / "c"), "llm_cache")
    assert got.columns == [f.split()[0] for f in files.SCHEMAS["llm_cache"].split(", ")] and got.first().value is None
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_text("<p>\nx</p>")
    assert files.landed_pages(spark, str(tmp_path / "p")).first().html == "<p>\nx</p>"
    assert files.api_payloads(spark, str(tmp_path / "p")).first().site_url.endswith("a.html")
    sinks.export_json_lines(got, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_windows_of_fetches(spark):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("a", 200, at(0)), ("a", 500, at(7)), ("a", 200, at(50)), ("b", 200, at(3))], "domain string, status int, ts timestamp")
    assert sorted((r.domain, r.n) for r in crawl.sessions(df).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    moving = {(r.domain, r.start.minute if r.start.hour == 0 and r.start.day == 1 else -5): (r.n_failed, r.n) for r in crawl.moving_health(df).collect()}
    assert moving[("a", 0)] == (1, 2) and moving[("a", 5)] == (1, 1) and moving[("a", -5)] == (0, 1)


def test_blocks_change_nothing(spark):
    import random

    r = random.Random(3)
    rows = [(f"d{r.randrange(3)}", k, float(r.randrange(400)), float(r.randrange(1, 9))) for k in range(300)]
    df = spark.createDataFrame(rows, "domain string, id long, asked double, delay double")
    want, last = {}, {}
    for d, k, asked, delay in rows:
        last[d] = want[k] = max(asked, last.get(d, -1e9) + delay)
    for block in (1, 7, 1000):
        assert {x.id: x.start for x in state.spaced(df, block).collect()} == want
    spans = [(f"d{r.randrange(3)}", a := r.randrange(200), a + r.randrange(0, 60)) for _ in range(200)]
    most = {d: max(sum(x == d and a <= t < b for x, a, b in spans) for t in range(300)) for d in ("d0", "d1", "d2")}
    for block in (1, 13, 1000):
        got = state.most_open(spark.createDataFrame(spans, "domain string, started long, ended long"), "domain", block)
        assert {x.domain: x.most_open for x in got.collect()} == most


@pytest.mark.parametrize(
    "title, once",
    [
        ("Data Analyst data  analyst", "Data Analyst"), ("Backend EngineerBackend Engineer", "Backend Engineer"), ("ΟΔΟΣ Α ΟΔΟΣ Α", "ΟΔΟΣ Α"), ("ΛΟΓΟΣ λογος", "ΛΟΓΟΣ"),
        ("QA Lead\nQA  lead\nBerlin", "QA Lead"), ("QA Lead\nBerlin\nQA Lead", "QA Lead Berlin"), ("Data Analyst II", "Data Analyst II"), ("abab", "abab"), (None, None),
    ],
)
def test_repeated_titles(spark, title, once):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(text.unrepeated(F.col("t"))).first()[0] == once


def test_candidate_words_and_translation(spark):
    df = spark.createDataFrame([("Beraterinnen in Vollzeit",), ("Assistenz des Geschäftsführers",), ("Data Scientist",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.candidate_title(F.col("t")), text.translated(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["berater", "assistenz der geschäftsführung", "data scientist", ""]
    assert [g[1] for g in got] == ["Consultantinnen in Full-time", "Assistenz des Managing Directors", "Data Scientist", None]


def test_first_rows_travel_without_idle_columns(spark):
    """Keys and places aren't carried twice, nor what isn't asked for."""
    from pyspark.sql import functions as F

    from jobstrata.operators import postings

    rows = [(k, k % 3, k % 5 if k % 7 else None, f"t{k % 4}", f"long {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, site long, pos long, title string, idle string")
    want = {}
    for r in rows:
        key, place = (r[1], r[3]), (r[2] is not None, r[2] or 0, r[0])
        want[key] = min(want.get(key, (place, r)), (place, r))
    got = postings.first_of_each(df, ["site", F.upper("title")], ["pos", "id"])
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {r for _, r in want.values()}
    few = postings.first_of_each(df, ["site", F.upper("title")], ["pos", "id"], ["id", "title"])
    assert {tuple(r) for r in few.collect()} == {(r[0], r[3]) for _, r in want.values()}
    assert "idle" not in few._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0].split("Project")[-1]
    assert "__v_" not in postings.first_of_each(df.select("id", "site"), ["site"], ["id"])._jdf.queryExecution().optimizedPlan().toString()


def test_scanned_rows_travel_once(spark):
    """The row that counts is found without a second copy of its columns."""
    from jobstrata.operators import postings

    rows = [(1, 5, "Dev", None, "u2", 7), (1, 5, "Dev", None, "u1", 8), (1, 4, "Dev ", "", None, 9), (1, 4, "Dev ", "", "", 3), (2, None, "Ops", "Wien", "u", 1), (2, 3, "Ops", "Wien", "u", 2), (None, 1, "x", "y", "z", 4)]
    scan = spark.createDataFrame(rows, "site_id long, pos long, title string, location string, url string, n int")
    got = postings.first_found(scan, ["site_id", "k_title", "k_location"])
    assert {tuple(r.new) for r in got.collect()} == {(1, 4, "Dev ", "", "", 3), (2, None, "Ops", "Wien", "u", 1), (None, 1, "x", "y", "z", 4)}
    assert got.schema["new"].dataType.names == scan.columns
    assert "min_by" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_rewritten_once(spark):
    """the rewriting of a title doesn't stand within the search for each word."""
    from pyspark.sql import functions as F

    from jobstrata.functions import text

    df = spark.createDataFrame([("Senior Entwickler (m/w/d)",), ("About us",), (None,), ("",)], "title string").select(text.title_signals(F.col("title")).alias("s"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?U)[^") == 1
    assert [r.s is None or r.s.title_has_keywords for r in df.collect()][1] is False


def test_patterns_of_platforms_are_tried_where_their_piece_stands(spark):
    """and give what all of them would give."""
    from pyspark.sql import functions as F

    from jobstrata.functions import urls

    assert all(p and p.isascii() and p == p.lower() for p in urls._PIECES)
    rows = [(u,) for u in ("https://a.jobs.personio.de/x", "https://A.JOBS.PERSON\u0130O.COM", "https://boards.greenhouse.io", "https://JOB-BOARDS.greenhou\u017fe.io", "https://x.bamboohr.com/jobs", "https://x.bamboohr.com/j",
            "https://a.factorial.co/job_posting/1", "https://x.pi-asp.de/bewerber-web", "https://join.com/companies/a", "https://join.com/a/jobs", "https://join.com/a", "https://a.wor\u212aable.com", "https://jobdb.softgarden.de", "", None)]
    df = spark.createDataFrame(rows, "u string").select("u", urls.platform(F.col("u")).alias("p"), urls.first_match(F.col("u"), urls.PLATFORMS).alias("w"))
    got = df.collect()
    assert [r.p for r in got] == [r.w for r in got] and len({r.p for r in got}) >= 8


def test_pages_come_in_small_batches(spark):
    """what a worker holds is bounded by a batch, whatever the table's size."""
    from jobstrata.operators import extract

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        extract.extracted(spark.createDataFrame([(1, "u", "<p>", "lever")], "page_id long, url string, html string, platform string"))
        assert [spark.conf.get(n) for n in names] == [str(extract.BATCH_ROWS), str(extract.BATCH_BYTES)]
        spark.conf.set(names[0], "77")
        extract.small_batches(spark)
        assert spark.conf.get(names[0]) == "77"
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_selectors_are_read_once():
    """not for each element that is looked into."""
    from jobstrata.operators import dom

    page = dom.parse('<ul><li class="a"><b>x</b></li><li class="a"><b>y</b></li></ul>')
    dom._alternatives.cache_clear()
    assert [x.one("b, i.c").text() for x in page.select("li.a")] == ["x", "y"] and page.one("u") is None
    assert dom._alternatives.cache_info().misses == 3

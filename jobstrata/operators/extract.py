"""Table functions over pages: one page gives any number of postings or links.

A page is parsed once; all that is asked of it comes from that one tree.  Each
platform is a description of where things stand in its pages, read by one
engine; only what doesn't fit a description has a function of its own.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .dom import Node, parse
from .postings import first_of_each

POSTING = "title string, location string, url string, department string, company string"


def _clean(title: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        title = re.sub(pattern, new, title, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", title).strip()


def _posting(title, location="Unknown", url="", department=None, company=None) -> dict:
    return {"title": title, "location": location or "Unknown", "url": url, "department": department, "company": company}


# --- structured data ---------------------------------------------------------------


def json_blocks(page: Node) -> Iterator[object]:
    for s in page.select("script[type]"):
        if s.attrs["type"].lower() in ("application/ld+json", "application/json"):
            try:
                yield json.loads("".join(c for c in s.children if isinstance(c, str)))
            except ValueError:
                continue


def _job_postings(page: Node) -> Iterator[dict]:
    for data in json_blocks(page):
        items = data if isinstance(data, list) else [data] if isinstance(data, dict) and data.get("@type") == "JobPosting" else data.get("@graph", []) if isinstance(data, dict) else []
        yield from (x for x in items if isinstance(x, dict) and x.get("@type") == "JobPosting")


def json_ld(page: Node, base: str) -> list[dict]:
    """JobPosting objects at the root, in a root array or in @graph."""
    out = []
    for d in _job_postings(page):
        place, org = d.get("jobLocation"), d.get("hiringOrganization")
        address = place.get("address") if isinstance(place, dict) else None
        location = address.get("addressLocality") if isinstance(address, dict) else address
        out.append(_posting(d.get("title", "Unknown"), location, urljoin(base, d["url"]) if d.get("url") else base, d.get("industry"), org.get("name") if isinstance(org, dict) else None))
    return out


def microdata(page: Node, base: str) -> list[dict]:
    """Elements of an itemtype that names JobPosting."""
    out = []
    for item in page.select("[itemtype*=JobPosting]"):
        title, url, place = item.one("[itemprop=title], [itemprop=name]"), item.one("[itemprop=url]"), item.one("[itemprop=jobLocation] [itemprop=addressLocality]")
        if title is not None:
            out.append(_posting(title.text(), place.text() if place else None, urljoin(base, url.attrs.get("href", "")) if url else base))
    return out


# --- platforms ---------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where a platform's postings stand.  Selectors are looked up in the card."""

    cards: tuple[str, ...]  # tried in order; the first that gives postings counts
    title: str = ""
    location: str = ""
    department: str = ""
    link: str = "a[href]"
    href: str = ""  # the link must match
    skip: str = ""  # and must not match
    rules: tuple[tuple[str, str], ...] = ()
    unique: bool = True
    split: tuple[str, ...] = ()  # "title, location" patterns of a plain text
    around: tuple[str, ...] = ()  # tags of the element around a link card
    shortest: int = 1
    marks: tuple[str, ...] = ()  # places known by name, in a span, p or div
    company: str = ""
    default: str | None = None  # location if none is found
    number: str = ""  # what of the link makes a posting unique
    most: int = 0  # postings of a page, where the site's own list is cut
    banned: tuple[str, ...] = ()  # titles that are none
    parts: bool = False  # one text holds title, place and department
    near: tuple[str, ...] = ()  # places known by name, in the text of the elements around
    levels: int = 0  # how many elements around are looked at
    term: bool = False  # the title must hold what the page was searched for


_BADGES = [(r"\s*\bNew\s*$", ""), (r"\s*\[New\]\s*", " ")]
_SPLITS = (r"^(.+?)\s*[|–—-]\s*([A-Z][^|–—-]+)$", r"^(.+?),\s+([A-Z][a-zäöüß]+(?:\s*,\s*[A-Za-zäöüß]+)?)$")

CITIES = ("Berlin", "München", "Hamburg", "Frankfurt", "Köln", "Düsseldorf", "Stuttgart", "Dresden", "Leipzig", "Hannover", "Nürnberg", "Mannheim", "Walldorf", "Magdeburg", "Görlitz", "Halle", "Remote", "Deutschlandweit")

LAYOUTS: dict[str, tuple[Layout, ...]] = {
    # Job links with the search term; the city from up to three elements around
    "deloitte": (
        Layout(
            ("a[href]",), href="/job-|/job/|/stelle/|/position/|jobdetail", shortest=5, banned=("zurück", "back", "weiter", "next", "details", "mehr"),
            near=CITIES, levels=3, default="Germany", term=True,
        ),
    ),
    "lever": (Layout((".posting, .posting-card",), ".posting-title, h5", ".location, .posting-categories", link="a", unique=False),),
    "greenhouse": (
        Layout(('.opening, .job-post, [data-mapped="true"]',), "a, .opening-title, .job-title", ".location, .job-location", link="a", rules=((r"\s*\bNew$", ""),), unique=False),
    ),
    "odoo": (
        Layout((".card.card-default, [class*=o_job], a[href*=\"/jobs/detail/\"]",), "h3, h4, h5, [class*=title]", href=r"/jobs/", marks=("Köln", "Berlin", "München", "Hamburg", "Frankfurt", "Remote", "Deutschland")),
    ),
    "softgarden": (
        Layout(
            ("a[href]",), "", "[class*=location], [class*=ort], [class*=city], [class*=standort]", "[class*=department], [class*=abteilung], [class*=bereich], [class*=category]",
            href=r"/job/|/vacancies/|/vacancy/|/stelle/", skip=r"\?page=|\?filter|\?sort|#|/search|/login|/register",
            rules=((r"\s*\(all genders?\)\s*", " "), (r"\s*–\s*Jetzt bewerben!?\s*$", ""), (r"\s*-\s*Apply now!?\s*$", "")),
            split=_SPLITS, around=("div", "li", "article", "tr"), shortest=3,
        ),
        Layout(
            ("[class*=job-card]", "[class*=job-listing]", "[class*=job-item]", "[class*=vacancy-card]", "[class*=position-card]", "article[class*=job]", ".job-row", "li[class*=job]"),
            "h2, h3, h4, [class*=title]", "[class*=location], [class*=ort]", "[class*=department], [class*=category]",
        ),
    ),
    "join": (
        Layout(
            ("[class*=job-card], [class*=JobCard], [class*=position-card], [class*=vacancy], article[class*=job], li[class*=job]", ".join-jobs-widget a[href]", 'a[href*="join.com"]'),
            "h2, h3, h4, [class*=title], [class*=Title]", "[class*=location], [class*=Location], [class*=city], [class*=City]",
            href=r"/jobs?/|join\.com", skip=r"\?page=|\?filter|/search|/companies$|/login|/register|/pricing|/about",
            rules=((r"^\s*(?:New|Neu)\b\s*(?=[A-Z].*\()", ""), (r"\s*\b(?:New|Neu)\s*$", "")),
        ),
    ),
    "recruitee": (Layout(('a[href*="/o/"]',), skip=r"/c/new"),),
    "workable": (Layout(('li[class*=job], li a[href*="/j/"]', 'a[href*="/j/"]'), link='a[href*="/j/"]', href=r"/j/", skip=r"/gdpr|/privacy|/cookie", parts=True, around=("li",)),),
    "stepstone": (
        Layout(("article[data-at=job-item]", "article[class*=res-]"), "[data-at=job-item-title], h2, h3", "[data-at=job-item-location], [class*=location]", company="[data-at=job-item-company-name], [class*=company], [class*=employer]", default="Germany", unique=False),
        Layout(('a[href*="/stellenangebote--"]',), default="Germany", shortest=6, most=25, unique=False),
    ),
    "karriere": (
        Layout(
            ("a[href]",), "", "[class*=location], [class*=ort], [class*=city]", href=r"/jobs/\d+(?:\?|$)", number=r"/jobs/(\d+)", company='a[href*="/firma/"], [class*=company], [class*=firma], [class*=employer]',
            default="Austria", around=("div", "li", "article"), shortest=10, most=25, banned=tuple(text.CITIES_AT),
        ),
    ),
}


def read(page: Node, base: str, layouts: tuple[Layout, ...]) -> list[dict]:
    for layout in layouts:
        for selector in layout.cards:
            got = list(islice(_cards(page, base, layout, selector), layout.most or None))
            if got:
                return got
    return []


def _around(x: Node, levels: int) -> Iterator[Node]:
    while levels and (x := x.parent) is not None:
        levels -= 1
        yield x


def _searched(url: str) -> str:
    """What a results page was searched for."""
    m = re.search(r"[?&](?:search|q|query|keyword)=([^&#]+)", url)
    return m[1].replace("+", " ").lower() if m else ""


def _cards(page: Node, base: str, o: Layout, selector: str) -> Iterator[dict]:
    seen, term = set(), _searched(base) if o.term else ""
    for card in page.select(selector):
        link = card if card.tag == "a" else card.one(o.link)
        href = link.attrs.get("href", "") if link is not None else ""
        if o.href and not re.search(o.href, href, re.IGNORECASE) or o.skip and re.search(o.skip, href, re.IGNORECASE):
            continue
        url = urljoin(base, href) if href else base
        key = re.search(o.number, href)[1] if o.number else url
        if o.unique and key in seen:
            continue
        seen.add(key)
        head = card.one(o.title) if o.title else None
        if o.title and head is None and not o.unique:
            continue
        title = head.text() if head is not None else (link or card).text(" ")
        box = (card.up(*o.around) or card) if o.around else card
        places = [x for x in box.select(o.location) if x is not link] if o.location else []
        if o.marks and not places:
            places = [x for x in card.select("span, p, div") if any(m in x.text() for m in o.marks)]
        units = [x for x in box.select(o.department) if x is not link] if o.department else []
        firm = box.one(o.company) if o.company else None
        unit = units[0].text() if units else None
        location = places[0].text()[: 100 if o.marks else None] if places else o.default
        if location is None and o.split:
            title, location = split_title(title, o.split)
        if o.near:
            location = next((c for x in _around(card, o.levels) for c in o.near if c in x.text(" ")), o.default)
        if o.parts:
            title, location, unit = card_parts((card if card.tag == "li" else box).text(" "))
        if len(title) >= o.shortest and term in title.lower() and title.lower() not in o.banned and (title := _clean(title, list(o.rules))):
            yield _posting(title, location, url, unit, firm.text() if firm is not None else None)


def split_title(title: str, patterns: tuple[str, ...]) -> tuple[str, str | None]:
    """V12, V13: "title - Location" or "title, City" as two parts."""
    for p in patterns:
        if m := re.search(p, title):
            return m[1].strip(), m[2].strip()
    return title, None


def greenhouse(page: Node, base: str) -> list[dict]:
    """Job links under their nearest heading, else the older layout."""
    out, seen, heading = [], set(), None
    for x in page.walk():
        if x.tag in ("h2", "h3") or "department" in x.attrs.get("class", ""):
            heading = x.text()
        if x.tag == "a" and "/jobs/" in x.attrs.get("href", ""):
            url = urljoin(base, x.attrs["href"])
            if url not in seen:
                seen.add(url)
                parts = x.elements()
                title, location = (parts[0].text(), parts[1].text()) if len(parts) > 1 else split_title(x.text(), _SPLITS)
                if title := _clean(title, _BADGES):
                    out.append(_posting(title, location, url, heading))
    return out or read(page, base, LAYOUTS["greenhouse"])


def personio(page: Node, base: str) -> list[dict]:
    """X4, V15: "Title (all)Employment type, hours·Place·Place" links."""
    out, seen = [], set()
    kinds = ("(Permanent employee|Intern / Student|Working student|Freelancer)", "(Full-time|Part-time|Teilzeit|Vollzeit)")
    for a in page.select('a[href*="/job/"]'):
        url = urljoin(base, a.attrs["href"])
        if url in seen:
            continue
        seen.add(url)
        whole = a.text(" ")
        title, location = whole, None
        for kind in kinds:
            # the first kind that is found decides; its own spelling is cut at
            if (m := re.search(kind, whole, re.IGNORECASE)) and (cut := whole.find(m[1])) > 0:
                title = whole[:cut]
                place = re.search(r"·\s*([^·]+)", whole[cut:])
                location = place[1].strip() if place else None
                break
        if title := _clean(title, [(r"\s*\(all\)\s*$", "")]):
            out.append(_posting(title, location, url))
    return out


@dataclass(frozen=True)
class Listed:
    """Items with a heading and a line of facts, such as unit, place and kind."""

    item: str
    heading: str
    line: str  # what stands between the facts of a line
    places: str  # a fact that is a place ...
    others: str  # ... unless it is one of these
    sign: str  # what marks a title where the heading is missing, and no unit
    default: str = "Remote"


LISTED = {
    "hibob": Listed(
        "b-virtual-scroll-list-item", "b-heading", "·", "remote|hybrid|munich|berlin|germany|london|amsterdam|europe",
        "permanent|full-time|part-time|posted|dev|infrastructure|marketing|operations", r"\([fmwdx]/[fmwdx]",
    )
}


def listed(page: Node, base: str, o: Listed) -> list[dict]:
    """The first item of each title; its address is made of the title."""
    found = functools.partial(re.search, flags=re.IGNORECASE)
    by_title: dict[str, tuple[str, list[str]]] = {}
    for item in page.select(o.item):
        heads, lines = [h.text() for h in item.select(o.heading)[:1]], [d.text() for d in item.select("div")]
        title = [*heads, *filter(functools.partial(found, o.sign), [] if heads else lines), ""][0]
        facts = next(filter(lambda t: o.line in t, lines), "")
        by_title.setdefault(title.lower().strip(), (title, [f.strip() for f in facts.split(o.line)]))
    return [_posting(t, _place(facts, o), urljoin(base.rstrip("/") + "/", _slug(t)), _unit(facts, o)) for t, facts in by_title.values() if t]


def _place(facts: list[str], o: Listed) -> str:
    of = [f for f in facts if re.search(o.places, f, re.IGNORECASE) and not re.search(o.others, f, re.IGNORECASE)]
    if not of:
        return o.default
    towns = re.sub(r"(?i)(?<!\S)remote(?!\S)", "", of[0]).split()
    return ", ".join([*towns, "Remote"]) if towns and "remote" in of[0].lower() else of[0]


def _unit(facts: list[str], o: Listed) -> str | None:
    return facts[0] if len(facts) > 1 and len(facts[0]) < 50 and not re.search(o.sign, facts[0], re.IGNORECASE) else None


def _slug(title: str) -> str:
    plain = re.sub(r"(?i)\s*\([fmwdx]/[fmwdx](/[fmwdx])?\)\s*", " ", title)
    return "-".join(re.findall("[a-z0-9]+", plain.lower()))


def hrworks(page: Node, base: str) -> list[dict]:
    """Offer links; unit and place from the box around them."""
    out, seen = [], set()
    for a in page.select("a.job-offer-content"):
        url = urljoin(base, a.attrs.get("href", ""))
        if "?id=" not in a.attrs.get("href", "") or url in seen:
            continue
        seen.add(url)
        h2, box = a.one("h2"), a.up("div", cls="portlet")
        title = (h2.text() if h2 is not None else "") or a.attrs.get("title", "").strip() or a.text()
        unit = place = None
        if box is not None:
            meta = box.one("div.margin-top-10")
            unit = next((p.strip() for p in meta.text().split(" - ") if p.strip()), None) if meta is not None else None
            for icon in box.select("i.icomoon-location") + box.select("i.icomoon-home"):
                around = icon.up("a")
                span = around.one("span") if around is not None else None
                place = place or (span.text() if span is not None else None)
        if title:
            out.append(_posting(title, place, url, unit))
    return out


def workable(page: Node, base: str) -> list[dict]:
    """Structured data with the full address, else cards, else links."""
    out = []
    for d in _job_postings(page):
        place = d.get("jobLocation")
        first = place[0] if isinstance(place, list) and place else place
        address = first.get("address") if isinstance(first, dict) else None
        if isinstance(address, dict):
            country = address.get("addressCountry")
            parts = [address.get("addressLocality"), None if isinstance(place, list) else address.get("addressRegion"), country.get("name") if isinstance(country, dict) else country]
            address = ", ".join(p for p in parts if p)
        if title := d.get("title") or d.get("name"):
            out.append(_posting(title, address, d.get("url") or base, d.get("occupationalCategory")))
    return out or read(page, base, LAYOUTS["workable"])


def offers(data: list, base: str, link: Callable[[dict], str]) -> list[dict]:
    """Offer objects; the place from its parts if it isn't given."""
    out, seen = [], set()
    for o in data:
        url = link(o)
        if url in seen or not o.get("title"):
            continue
        seen.add(url)
        place = o.get("location") or ", ".join(p for p in (o.get("city"), o.get("state_name"), o.get("country")) if p)
        out.append(_posting(o["title"], place, url or base, o.get("department")))
    return out


def recruitee(page: Node, base: str) -> list[dict]:
    for s in page.select("script"):
        m = re.search(r'"offers"\s*:\s*(\[.*?\])\s*[,}]', "".join(c for c in s.children if isinstance(c, str)), re.DOTALL)
        if m:
            try:
                if got := offers(json.loads(m[1]), base, lambda o: o.get("careers_url") or o.get("url") or ""):
                    return got
            except ValueError:
                continue
    return read(page, base, LAYOUTS["recruitee"])


PARSERS: dict[str, Callable[[Node, str], list[dict]]] = {
    "personio": personio, "greenhouse": greenhouse, "workable": workable, "recruitee": recruitee, "hrworks": hrworks,
} | {n: (lambda page, base, n=n: read(page, base, LAYOUTS[n])) for n in ("lever", "odoo", "softgarden", "join", "stepstone", "karriere", "deloitte")} | {
    n: (lambda page, base, o=o: listed(page, base, o)) for n, o in LISTED.items()
}


# --- as DataFrames -----------------------------------------------------------------


#: Rows and bytes of an Arrow batch of pages: a worker holds a batch as a whole.
BATCH_ROWS, BATCH_BYTES = 200, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep batches of pages small, unless the session asks for sizes of its own; plans
    read these settings when they run, so they stay set."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, str(BATCH_BYTES))


def extracted(pages: DataFrame) -> DataFrame:
    """Postings of pages (page_id, url, html, platform).

    A known platform's parser comes first; structured data only where there is
    no platform.  Open applications are dropped (F3) in the plan, not in Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, url, html, platform in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["platform"], strict=True):
                tree = parse(html)
                if platform is not None:
                    got, method = (PARSERS[platform](tree, url or "") if platform in PARSERS else []), f"job_board:{platform}"
                else:
                    got, method = json_ld(tree, url or "") or microdata(tree, url or ""), "schema_org"
                rows += [(page_id, k, method, *(p[c] for c in ("title", "location", "url", "department", "company"))) for k, p in enumerate(got)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "method", "title", "location", "url", "department", "company"])

    small_batches(pages.sparkSession)
    out = pages.select("page_id", "url", "html", "platform").mapInPandas(run, f"page_id long, pos long, method string, {POSTING}")
    return out.where(~text.is_open_application(F.col("title")))


LINKS = "page_id long, pos long, element long, kind string, url string, href string, text string, plain string"
_SCRIPT_URL = re.compile(r"https?://[^\s\"'<>]+")


def _sources(x: Node) -> Iterator[tuple[str, str]]:
    """Kind and address of what an element refers to."""
    for kind, attr in (("a", "href"), ("iframe", "src"), ("data", "data-src")):
        href = x.attrs.get(attr, "").strip()
        if href and (kind == "data" or x.tag == kind) and not href.startswith(("#", "javascript:")):
            yield kind, href
    if x.tag == "script":
        yield from (("script", m) for c in x.children if isinstance(c, str) for m in _SCRIPT_URL.findall(c))


def links(pages: DataFrame) -> DataFrame:
    """X17, X18's sources: a[href], iframe[src], [data-src] and the addresses in
    scripts, absolute, with their text; ``element`` counts the elements."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, base, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                pos = 0
                for x in parse(html).walk():
                    element = pos
                    for kind, href in _sources(x):
                        said = (x.text(" ")[:50], x.text()[:50]) if kind != "script" else ("", "")
                        rows.append((page_id, pos, element, kind, urljoin(base or "", href), href, *said))
                        pos += 1
            yield pd.DataFrame(rows, columns=["page_id", "pos", "element", "kind", "url", "href", "text", "plain"])

    return pages.select("page_id", "url", "html").mapInPandas(run, LINKS)


#: Links of a page that are shown to a model (fixed value).
SHOWN_LINKS = 200


def distinct_links(link_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Each address of a page once, in page order, as ``url [text]``."""
    once = first_of_each(link_rows.where("kind = 'a'").select("page_id", "pos", "url", "plain"), ["page_id", "url"], [F.col("pos").alias("o")])
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    label = F.when(F.col("plain") != "", F.concat("url", F.lit(" ["), "plain", F.lit("]"))).otherwise(F.col("url"))
    out = once.select("page_id", place.cast("long").alias("pos"), "url", label.alias("label"))
    return out if limit is None else out.where(F.col("pos") < limit)


def answer_urls(answers: DataFrame) -> DataFrame:
    """The addresses in a model's answer (page_id, url, answer), absolute,
    each once, in order; what isn't a list or not a text gives none."""
    items = answers.select("page_id", F.col("url").alias("base"), F.posexplode(F.expr("try_cast(try_parse_json(answer) as array<variant>)")).alias("o", "v"))
    texts = items.where("schema_of_variant(v) = 'STRING'").select("page_id", "base", "o", F.trim(F.expr("try_variant_get(v, '$', 'string')")).alias("t")).where("t <> ''")
    joined = texts.select("page_id", "o", joined_urls(F.col("base"), F.col("t")).alias("url"))
    once = first_of_each(joined, ["page_id", "url"], [F.col("o").alias("o1")])
    return once.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("o")) - 1).alias("pos"), "url")


def document_postings(link_rows: DataFrame) -> DataFrame:
    """Postings from document links whose file name speaks of a job."""
    name = F.element_at(F.split("href", "/"), -1)
    words = "stellenausschreibung|stellenangebot|stellenanzeige|jobausschreibung|jobangebot|jobanzeige|karriere|career|vacancy|position|job_posting|job-posting|jobposting"  # fixed values
    hits = link_rows.where((F.col("kind") == "a") & F.col("href").rlike(r"(?i)\.(pdf|docx?)$") & name.rlike(f"(?i){words}"))
    titled = hits.withColumn("title", text.filename_title(name)).where("title <> ''")
    return first_of_each(titled, ["page_id", F.lower("title")], [F.col("pos").alias("o")]).select("page_id", "pos", "title", "url")


def external_boards(link_rows: DataFrame) -> DataFrame:
    """The first reference of a page to a recruiting platform, as its jobs page.

    Links come before frames, other sources and scripts; legal pages count only
    where there is nothing else; within an element the platforms' own order.
    """
    rows = link_rows.withColumn("platform", urls.platform(F.col("href"))).where("platform is not null")
    kind = F.array_position(F.array(*map(F.lit, ("a", "iframe", "data", "script"))), F.col("kind"))
    rule = F.array_position(F.array(*[F.lit(n) for _, n in urls.PLATFORMS]), F.col("platform"))
    order = F.struct((~urls.is_board_page(F.col("href"))).alias("legal"), kind.alias("kind"), "element", rule.alias("rule"), "pos")
    best = rows.groupBy("page_id").agg(F.min_by(F.struct("href", "platform"), order).alias("b"))
    return best.select("page_id", F.col("b.platform").alias("platform"), urls.board_url(F.col("b.href"), F.col("b.platform")).alias("board_url"))


def careers_links(link_rows: DataFrame) -> DataFrame:
    """The first link whose URL or text speaks of careers."""
    words = "career|jobs|vacancies|openings|join us|work with us|we're hiring|karriere|stellen|jobangebote|arbeiten bei uns|jetzt bewerben|вакансии|карьера|работа у нас|присоединяйся"
    hits = link_rows.where((F.col("kind") == "a") & (urls.is_careers_url(F.col("href")) | F.lower("text").rlike(words)))
    return hits.groupBy("page_id").agg(F.min_by("url", "pos").alias("careers_url"))


def api_offers(payloads: DataFrame) -> DataFrame:
    """X10, SC11: offers of a JSON answer (site_url, body), all in the plan."""
    offer = "struct<title:string,location:string,city:string,state_name:string,country:string,careers_url:string,slug:string,department:string>"
    rows = payloads.select("site_url", F.posexplode(F.from_json("body", f"struct<offers:array<{offer}>>")["offers"]).alias("pos", "o"))
    some = lambda c: F.nullif(F.col(f"o.{c}"), F.lit(""))
    parts = F.nullif(F.concat_ws(", ", some("city"), some("state_name"), some("country")), F.lit(""))
    slug = F.when(some("slug").isNotNull(), F.concat(urls.origin(F.col("site_url")), F.lit("/o/"), some("slug")))
    return rows.where(some("title").isNotNull()).select(
        "site_url", "pos", some("title").alias("title"), F.coalesce(some("location"), parts, F.lit("Unknown")).alias("location"),
        F.coalesce(some("careers_url"), slug, F.col("site_url")).alias("url"), some("department").alias("department"),
    )


def vacancies(payloads: DataFrame) -> DataFrame:
    """X20, SC7: items of a job-site answer (body), all in the plan."""
    item = (
        "struct<id:string,name:string,alternate_url:string,employer:struct<name:string>,area:struct<name:string>,published_at:string,"
        "salary:struct<`from`:int,`to`:int,currency:string>,experience:struct<name:string>,employment:struct<name:string>>"
    )
    rows = payloads.select(F.inline(F.from_json("body", f"struct<items:array<{item}>>")["items"]))
    return rows.select(
        "id", F.col("name").alias("title"), F.coalesce("employer.name", F.lit("Unknown")).alias("company"), F.coalesce("area.name", F.lit("")).alias("location"),
        F.col("alternate_url").alias("url"), F.col("salary.from").alias("salary_from"), F.col("salary.to").alias("salary_to"), F.col("salary.currency").alias("salary_currency"),
        F.col("experience.name").alias("experience"), F.col("employment.name").alias("employment_type"), F.try_to_timestamp("published_at").alias("published_at"),
    )


def vacancy_details(payloads: DataFrame) -> DataFrame:
    """SC8: description and skills of a vacancy's own answer (body)."""
    got = F.from_json("body", "struct<id:string,description:string,key_skills:array<struct<name:string>>>")
    return payloads.select(got.alias("v")).select("v.id", "v.description", F.col("v.key_skills.name").alias("skills"))


def joined_urls(base, href):
    """L2: full RFC 3986 resolution, for the forms that ``urls.full_url`` doesn't cover."""

    @F.pandas_udf("string")
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([urljoin(x or "", y or "") for x, y in zip(b, h, strict=True)])

    return run(base, href)


def listing_links(link_rows: DataFrame) -> DataFrame:
    """the link of a page that leads to its list of postings.

    Links by their address come before links by their text; within each, the
    first in the page.  Links to single postings don't count.
    """
    low = F.lower("text")
    ok = ~(urls.is_single_posting(F.col("href")) | urls.is_single_posting(low))
    by_href, by_text = urls.matches(F.col("href"), urls.LISTING_HREFS), urls.matches(low, urls.LISTING_TEXTS)
    hits = link_rows.where((F.col("kind") == "a") & ok & (by_href | by_text)).withColumn("pass", F.when(by_href, 0).otherwise(1))
    return hits.groupBy("page_id").agg(F.min_by("url", F.struct("pass", "pos")).alias("listing_url"))


#: How much each way of extraction is trusted (fixed values).
TRUST = {"job_board": 1.0, "schema_org": 1.0, "pdf_link": 0.90, "llm": 0.85}


def cascade(by_parser: DataFrame, by_answer: DataFrame, by_document: DataFrame) -> DataFrame:
    """Platform or structured data alone, else answers and documents.

    All inputs have page_id, pos, method, title, location and url; answers are
    those of a model, computed elsewhere.  Pages with a parser's postings are
    taken out of the rest by an anti-join; of equal titles the first method's
    stays (U1c).
    """
    names = ["page_id", "pos", "method", "title", "location", "url"]
    found = by_parser.select("page_id").distinct()
    rest = by_answer.select(*names).unionByName(by_document.select(*names)).join(found, "page_id", "left_anti")
    return once_each(by_parser.select(*names).unionByName(rest))


def once_each(found: DataFrame) -> DataFrame:
    """Of a page's equal titles the one of the best method, with how much that is trusted."""
    everything = found.select("page_id", "pos", "method", "title", "location", "url")
    kind = F.split_part("method", F.lit(":"), F.lit(1))
    rank = F.when(kind == "job_board", 0).when(kind == "schema_org", 1).when(kind == "llm", 2).otherwise(3)
    trust = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TRUST.items()], F.lit(0.5))
    once = first_of_each(everything, ["page_id", text.candidate_title(F.col("title"))], [rank.alias("r"), F.col("pos").alias("p")])
    return once.withColumn("confidence", trust)


WORKPLACES, HOURS = ("Hybrid", "Remote", "On-site", "Onsite"), ("Full", "Part")


def card_parts(words: str) -> tuple[str, str | None, str | None]:
    """(title, location, department) of a card's text.

    A workplace word ends the title; what follows up to "All," or the hours is
    the place; what stands between "All," and the hours is the department.
    """
    cut = min((m.start() for w in WORKPLACES if (m := re.search(rf"\b{w}\b", words))), default=-1)
    title, tail = (words[:cut].strip(), words[cut:]) if cut > 0 else (words.strip(), "")
    for w in WORKPLACES:
        tail = re.sub(rf"^\s*{w}\b", "", tail)
    end = min((m.start() for h in HOURS if (m := re.search(rf"\b{h}\b", tail))), default=len(tail))
    place, _, unit = tail[:end].partition("All,")
    return title, place.strip(" ,·") or None, unit.strip(" ,·") or None

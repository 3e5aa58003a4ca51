"""Scalar functions and predicates over URLs, each with its SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import JAVA_FLAGS, first_match, first_match_sql, matches, matches_sql, once, quote  # noqa: F401

# --- fixed values --------------------------------------------------------------

PLATFORMS = [
    (r"\.jobs\.personio\.(?:de|com)", "personio"), (r"boards\.greenhouse\.io", "greenhouse"), (r"job-boards\.greenhouse\.io", "greenhouse"),
    (r"jobs\.lever\.co", "lever"), (r"\.workable\.com", "workable"), (r"\.breezy\.hr", "breezy"), (r"\.recruitee\.com", "recruitee"),
    (r"\.smartrecruiters\.com", "smartrecruiters"), (r"\.bamboohr\.com/jobs", "bamboohr"), (r"\.ashbyhq\.com", "ashby"),
    (r"\.factorial\.co/job_posting", "factorial"), (r"\.pi-asp\.de/bewerber-web", "pi-asp"), (r"job\.deloitte\.com", "deloitte"),
    (r"\.careers\.hibob\.com", "hibob"), (r"\.softgarden\.io", "softgarden"), (r"jobdb\.softgarden\.de", "softgarden"),
    (r"join\.com/companies/", "join"), (r"join\.com/[^/]+/jobs", "join"),
]
LEGAL = [r"/privacy[-_]?policy", "/datenschutz", "/imprint", "/impressum", "/terms", "/agb", "/legal", "/cookie", "/contact", "/kontakt"]
CAREERS = [
    "/career[s]?", "/job[s]?", "/vacanc(?:y|ies)", "/opening[s]?", "/work[-_]?with[-_]?us", "/join[-_]?us", "/join[-_]?our[-_]?team",
    "/hiring", "/positions", "/people[-_]?(?:and[-_]?)?jobs", "/karriere", "/stellen", "/stellenangebote", "/jobangebote", "/arbeiten",
    "/bewerben", "/offene[-_]?stellen", "/вакансии", "/карьера", "/работа",
]
PLURALS = [
    ("/job.html", "/jobs.html"), ("/job", "/jobs"), ("/vacancy.html", "/vacancies.html"), ("/vacancy", "/vacancies"),
    ("/opening.html", "/openings.html"), ("/opening", "/openings"), ("/career.html", "/careers.html"), ("/career", "/careers"),
    ("/stelle.html", "/stellen.html"), ("/stelle", "/stellen"),
]
LISTING_ENDINGS = [
    "/jobs", "/jobs.html", "/job", "/job.html", "/vacancies", "/vacancies.html", "/vacancy", "/vacancy.html", "/openings",
    "/openings.html", "/opening", "/opening.html", "/careers", "/careers.html", "/stellenangebote", "/stellenangebote.html",
    "/offene-stellen", "/offene-stellen.html", "/stellen", "/stellen.html", "/вакансии", "/вакансии.html",
]
GENERAL_ENDINGS = [
    "/career", "/career.html", "/karriere", "/karriere.html", "/people-jobs", "/people-jobs.html", "/people-and-jobs",
    "/people-and-jobs.html", "/карьера", "/карьера.html", "/работа", "/работа.html",
]
ALTERNATIVES = [
    "/careers", "/careers.html", "/jobs", "/jobs.html", "/vacancies", "/vacancies.html", "/career", "/career.html", "/join", "/team",
    "/about/careers", "/about-us/careers", "/company/careers", "/en/careers", "/karriere", "/karriere.html", "/stellen", "/stellen.html",
    "/stellenangebote", "/stellenangebote.html", "/offene-stellen", "/offene-stellen.html", "/de/karriere", "/ueber-uns/karriere",
    "/unternehmen/karriere", "/jobs-karriere", "/people-jobs", "/people-jobs/offene-stellen", "/people-and-jobs", "/ru/careers",
    "/o-kompanii/vakansii", "/company/vacancies",
]
SUBDOMAINS = ["jobs", "careers", "karriere", "career", "stellen", "join", "work", "hiring"]

# --- parts -----------------------------------------------------------------------

_ORIGIN, _HOST, _PATH, _QUERY = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", r"\?([^#]*)"


def origin(c: Column) -> Column:
    return F.regexp_extract(c, _ORIGIN, 1)


def origin_sql(c: str) -> str:
    return f"regexp_extract({c}, '{_ORIGIN}', 1)"


def host(c: Column) -> Column:
    return F.regexp_extract(c, _HOST, 1)


def host_sql(c: str) -> str:
    return f"regexp_extract({c}, '{_HOST}', 1)"


def path(c: Column) -> Column:
    return F.regexp_extract(c, _PATH, 1)


def path_sql(c: str) -> str:
    return f"regexp_extract({c}, '{_PATH}', 1)"


def bare_host(c: Column) -> Column:
    """Lower-case host without a leading www., for a URL or a bare domain."""
    return F.regexp_replace(F.lower(host(with_scheme(c))), r"^www\.", "")


def bare_host_sql(c: str) -> str:
    return f"regexp_replace(lower({host_sql(with_scheme_sql(c))}), '^www\\.', '')"


def with_scheme(c: Column) -> Column:
    return F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def with_scheme_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^https?://') THEN {c} ELSE 'https://' || {c} END"


def without_query(c: Column) -> Column:
    """L3: without query and fragment."""
    return F.regexp_replace(c, "[?#].*$", "")


def without_query_sql(c: str) -> str:
    return f"regexp_replace({c}, '[?#].*$', '')"


def search_term(c: Column) -> Column:
    """First value of the first search parameter present, decoded."""
    return F.coalesce(*[F.nullif(F.lower(F.try_url_decode(F.regexp_extract(c, rf"[?&]{p}=([^&#]*)", 1))), F.lit("")) for p in ("search", "q", "query", "keyword", "keywords")])


def search_term_sql(c: str) -> str:
    each = [f"nullif(lower(url_decode(replace(regexp_extract({c}, '[?&]{p}=([^&#]*)', 1), '+', ' '))), '')" for p in ("search", "q", "query", "keyword", "keywords")]
    return f"coalesce({', '.join(each)})"


#: Second-level names that are public suffixes with the top domain (fixed values).
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu", "gv", "or"]


def registrable_domain(host_: Column) -> Column:
    """The domain that was registered: two labels, or three where the second
    is a public name under a country.  Null for addresses and single names."""
    labels = F.split(F.lower(host_), r"\.")
    n = F.size(labels)
    public = (n >= 3) & labels[n - 2].isin(SECOND_LEVEL) & (F.length(labels[n - 1]) == 2)
    keep = F.when(public, 3).otherwise(2)
    return F.when((n >= 2) & ~host_.rlike(r"^[0-9.]+$"), F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def registrable_domain_sql(h: str) -> str:
    labels = f"string_split(lower({h}), '.')"
    second = ", ".join(map(quote, SECOND_LEVEL))
    keep = f"CASE WHEN len({labels}) >= 3 AND {labels}[-2] IN ({second}) AND length({labels}[-1]) = 2 THEN 3 ELSE 2 END"
    return f"CASE WHEN len({labels}) >= 2 AND NOT regexp_matches({h}, '^[0-9.]+$') THEN array_to_string({labels}[-({keep}):], '.') END"


def posting_number(url: Column, else_: Column) -> Column:
    """The number at the end of a posting's address, else the given one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"--(\d+)(?:\?|$)", 1), F.lit("")), else_)


def full_url(href: Column, base: Column) -> Column:
    """L1: href against base; ``//host`` keeps the base's scheme."""
    folder = F.regexp_replace(without_query(base), r"([^:/])/[^/]*$", "$1/")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(without_query(base), href))
        .otherwise(F.concat(F.when(path(base) == "", F.concat(origin(base), F.lit("/"))).otherwise(folder), href))
    )


def full_url_sql(href: str, base: str) -> str:
    folder = f"regexp_replace({without_query_sql(base)}, '([^:/])/[^/]*$', '\\1/')"
    return (
        f"CASE WHEN coalesce({href}, '') = '' THEN {base} WHEN starts_with({href}, 'http') THEN {href} "
        f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([a-z]+:)', 1) || {href} "
        f"WHEN starts_with({href}, '/') THEN {origin_sql(base)} || {href} "
        f"WHEN starts_with({href}, '?') OR starts_with({href}, '#') THEN {without_query_sql(base)} || {href} "
        f"ELSE CASE WHEN {path_sql(base)} = '' THEN {origin_sql(base)} || '/' ELSE {folder} END || {href} END"
    )


# --- predicates --------------------------------------------------------------------


#: For each pattern of a platform the longest plain piece that it can't do without.
_PIECES = [max(re.split(r"\\\.|[()?:|^\[\]+/$]", p.split("(")[0]), key=len) for p, _ in PLATFORMS]


def _platform_by_url(url: Column) -> Column:
    """A pattern is tried only where its plain piece stands in the address.

    The letters that a search without case takes for ASCII ones are rewritten before.
    """

    def named(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for (pattern, value), piece in reversed(list(zip(PLATFORMS, _PIECES, strict=True))):
            out = F.when(F.contains(low, F.lit(piece)) & url.rlike(JAVA_FLAGS + pattern), F.lit(value)).otherwise(out)
        return out

    return once(F.lower(F.translate(url, "\u017f\u212a\u0130\u0131", "skii")), named)


def platform(url: Column, html: Column | None = None) -> Column:
    """recruiting platform by URL, else by marks in the page."""
    by_url = _platform_by_url(url)
    if html is None:
        return by_url
    low = F.lower(html)
    has = lambda w: F.contains(low, F.lit(w))
    by_html = (
        F.when(has("talention"), "talention")
        .when(has("hrworks"), "hrworks")
        .when(has("join-jobs-widget") | has("data-join") | has("join.com/companies/") | has("join.com/widget"), "join")
        .when(has("softgarden") & (has("job-") | has("vacancy")), "softgarden")
    )
    return F.coalesce(by_url, by_html)


def platform_sql(url: str, html: str | None = None) -> str:
    by_url = first_match_sql(url, PLATFORMS)
    if html is None:
        return by_url
    has = lambda w: f"contains(lower({html}), '{w}')"
    return (
        f"coalesce({by_url}, CASE WHEN {has('talention')} THEN 'talention' WHEN {has('hrworks')} THEN 'hrworks' "
        f"WHEN {has('join-jobs-widget')} OR {has('data-join')} OR {has('join.com/companies/')} OR {has('join.com/widget')} THEN 'join' "
        f"WHEN {has('softgarden')} AND ({has('job-')} OR {has('vacancy')}) THEN 'softgarden' END)"
    )


def is_board_page(url: Column) -> Column:
    """not a privacy, imprint or other legal page."""
    return ~matches(url, LEGAL)


def is_board_page_sql(url: str) -> str:
    return f"NOT {matches_sql(url, LEGAL)}"


def is_careers_url(url: Column) -> Column:
    """F16."""
    return matches(url, CAREERS)


def is_careers_url_sql(url: str) -> str:
    return matches_sql(url, CAREERS)


def board_url(url: Column, name: Column) -> Column:
    """L4: the main jobs page of a platform's URL."""
    parts = F.struct(name.alias("name"), host(url).alias("host"), origin(url).alias("origin"))
    return once(parts, lambda p: _board_url(url, p["name"], p["host"], p["origin"]))


def _board_url(url: Column, name: Column, h: Column, o: Column) -> Column:
    first = F.regexp_extract(path(url), "^/*([^/]*)", 1)
    joined = F.regexp_extract(path(url), "^/*companies/([^/]+)", 1)
    lang = F.regexp_extract(url, r"\?[^#]*language=([a-z]{2})", 1)
    is_ = lambda n, mark: F.coalesce(name == n, F.lit(False)) | F.contains(h, F.lit(mark))
    return (
        F.when(is_("hibob", "careers.hibob.com"), F.concat(o, F.lit("/jobs")))
        .when(is_("greenhouse", "greenhouse.io"), F.concat(o, F.lit("/"), first))
        .when(is_("workable", "workable.com"), F.when(first != "", F.concat(o, F.lit("/"), first, F.lit("/"))).otherwise(F.concat(o, F.lit("/"))))
        .when(is_("deloitte", "deloitte.com"), url)
        .when(is_("softgarden", "softgarden"), F.concat(o, F.lit("/")))
        .when(is_("join", "join.com"), F.when(joined != "", F.concat(o, F.lit("/companies/"), joined)).otherwise(F.concat(o, F.lit("/"))))
        .otherwise(F.concat(o, F.lit("/"), F.when(lang != "", F.concat(F.lit("?language="), lang)).otherwise("")))
    )


def board_url_sql(url: str, name: str) -> str:
    first, o, h = f"regexp_extract({path_sql(url)}, '^/*([^/]*)', 1)", origin_sql(url), host_sql(url)
    joined = f"regexp_extract({path_sql(url)}, '^/*companies/([^/]+)', 1)"
    lang = f"regexp_extract({url}, '\\?[^#]*language=([a-z]{{2}})', 1)"
    is_ = lambda n, mark: f"coalesce({name} = '{n}', false) OR contains({h}, '{mark}')"
    return (
        f"CASE WHEN {is_('hibob', 'careers.hibob.com')} THEN {o} || '/jobs' WHEN {is_('greenhouse', 'greenhouse.io')} THEN {o} || '/' || {first} "
        f"WHEN {is_('workable', 'workable.com')} THEN CASE WHEN {first} <> '' THEN {o} || '/' || {first} || '/' ELSE {o} || '/' END "
        f"WHEN {is_('deloitte', 'deloitte.com')} THEN {url} WHEN {is_('softgarden', 'softgarden')} THEN {o} || '/' "
        f"WHEN {is_('join', 'join.com')} THEN CASE WHEN {joined} <> '' THEN {o} || '/companies/' || {joined} ELSE {o} || '/' END "
        f"ELSE {o} || '/' || CASE WHEN {lang} <> '' THEN '?language=' || {lang} ELSE '' END END"
    )


def variants(url: Column) -> Column:
    """The URL, then its first plural and its first singular form."""
    p, o = path(url), origin(url)

    def first(pairs):
        out = F.lit(None).cast("string")
        for a, b in reversed(pairs):
            out = F.when(p.endswith(a), F.concat(o, F.expr("''"), F.substring(p, F.lit(1), F.length(p) - len(a)), F.lit(b))).otherwise(out)
        return out

    return F.array_compact(F.array(url, first(PLURALS), first([(b, a) for a, b in PLURALS])))


def variants_sql(url: str) -> str:
    p, o = path_sql(url), origin_sql(url)
    first = lambda pairs: "CASE " + " ".join(f"WHEN ends_with({p}, '{a}') THEN {o} || substr({p}, 1, length({p}) - {len(a)}) || '{b}'" for a, b in pairs) + " END"
    return f"list_filter([{url}, {first(PLURALS)}, {first([(b, a) for a, b in PLURALS])}], lambda x: x IS NOT NULL)"


def careers_rank(url: Column) -> Column:
    """T4: sort key of a careers URL, lower is better."""
    p = F.regexp_replace(path(url), "/+$", "")
    bare = F.replace(p, F.lit(".html"), F.lit(""))
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    n = F.size(segments)

    def position(endings):
        out = F.lit(None).cast("int")
        for k, e in reversed(list(enumerate(endings))):
            out = F.when(p.endswith(e) | bare.endswith(e.replace(".html", "")), F.lit(k)).otherwise(out)
        return out

    listing, general = position(LISTING_ENDINGS), position(GENERAL_ENDINGS)
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    kind = F.when(listing.isNotNull(), 0).when(general.isNotNull(), 1).when(F.length(last) < 30, 2).otherwise(3)
    return F.struct(kind.alias("kind"), F.coalesce(listing, general, F.lit(0)).alias("ending"), n.alias("segments"), F.length(url).alias("size"))


def careers_rank_sql(url: str) -> tuple[str, str, str, str]:
    p = f"regexp_replace({path_sql(url)}, '/+$', '')"
    bare = f"replace({p}, '.html', '')"
    segments = f"list_filter(string_split({p}, '/'), lambda s: s <> '')"
    position = lambda endings: "CASE " + " ".join(f"WHEN ends_with({p}, '{e}') OR ends_with({bare}, '{e.replace('.html', '')}') THEN {k}" for k, e in enumerate(endings)) + " END"
    listing, general = position(LISTING_ENDINGS), position(GENERAL_ENDINGS)
    kind = f"CASE WHEN ({listing}) IS NOT NULL THEN 0 WHEN ({general}) IS NOT NULL THEN 1 WHEN length(coalesce({segments}[-1], '')) < 30 THEN 2 ELSE 3 END"
    return kind, f"coalesce({listing}, {general}, 0)", f"len({segments})", f"length({url})"


def company_variants(url: Column) -> Column:
    """how the source company may be written, from its host's first label."""
    number = r"^(\d+[a-z]?)(.*)$"

    def spelt(label: Column) -> Column:
        head = F.regexp_extract(label, number, 1)
        numbered = head != ""
        return F.array_compact(F.array(label, F.replace(label, F.lit("-"), F.lit(" ")), F.when(numbered, F.concat_ws(" ", head, F.regexp_extract(label, number, 2))), F.when(numbered, head)))

    return once(F.lower(F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")[0]), spelt)


def company_variants_sql(url: str) -> str:
    label = f"lower(string_split(regexp_replace({host_sql(url)}, '^www\\.', ''), '.')[1])"
    head, tail = f"regexp_extract({label}, '^(\\d+[a-z]?)(.*)$', 1)", f"regexp_extract({label}, '^(\\d+[a-z]?)(.*)$', 2)"
    return f"list_filter([{label}, replace({label}, '-', ' '), CASE WHEN {head} <> '' THEN {head} || ' ' || {tail} END, CASE WHEN {head} <> '' THEN {head} END], lambda x: x IS NOT NULL)"


def listed(values) -> str:
    return ", ".join(map(quote, values))


# --- patterns of links (fixed values) and their predicates -------------------------

BOARDS_SHORT = [
    r"\.jobs\.personio\.", r"boards\.greenhouse\.io", r"jobs\.lever\.co", r"\.workable\.com", r"\.breezy\.hr", r"\.recruitee\.com",
    r"\.smartrecruiters\.com", r"\.bamboohr\.com/jobs", r"\.ashbyhq\.com", r"job\.deloitte\.com", r"hrworks\.de",
]
SOFTGARDEN_MENU = [r"\?page=", r"\?filter", r"\?sort", "#", "/search", "/login", "/register"]
JOIN_MENU = [r"\?page=", r"\?filter", "/search", "/companies$", "/login", "/register", "/pricing", "/about"]
LISTING_PATHS = [
    "/jobs/?$", "/jobs/", "/careers/?$", "/careers/", "/stellenangebote/?$", "/stellenangebote/", "/vacancies/?$", "/vacancies/",
    "/offene-stellen/?$", "/offene-stellen/", "/karriere/stellen", "/career/positions",
]
SINGLE_POSTING = ["stellenprofil", "bewerbung", "bewerben", "job-detail", "/job/[^/]+$", "#apply", "#bewerbung"]
SITEMAP_WORDS = ["career", "job", "karriere", "stellen", "vacanc", "hiring", "join", "work"]
LISTING_HREFS = [r"karriere\.", "/jobs/?$", "/careers/?$", "/stellenangebote/?$"]
LISTING_TEXTS = [
    r"current\s*opening", r"open\s*positions?", r"job\s*(listings?|openings?)", r"all\s*(jobs?|positions?|openings?|vacancies)",
    r"(view|see)\s*all(?!\s*(highlight|article|news|blog|event|storie|project|client|partner|case))", r"browse\s*(jobs?|positions?|openings?)",
    r"career\s*(portal|opportunities)", r"job\s*portal", r"alle\s*stellen", r"offene\s*stellen", "stellenangebote", "stellenbörse",
    r"zur\s*stellenbörse", r"zum?\s*karriereportal", r"zu\s*den\s*jobs?", "karriereseite", "jobportal", r"все\s*вакансии",
    r"открытые\s*позиции", r"карьерный\s*портал",
]
LISTING_WORDS = ["jobs", "careers", "career", "vacancies", "openings", "stellen", "karriere", "stellenangebote", "offene-stellen", "вакансии", "карьера"]


def is_external_board(c: Column) -> Column:
    """recruiting platforms, by the crawler's own shorter list."""
    return matches(c, BOARDS_SHORT)


def is_external_board_sql(c: str) -> str:
    return matches_sql(c, BOARDS_SHORT)


def is_softgarden_menu(c: Column) -> Column:
    """links of that board's own navigation."""
    return matches(c, SOFTGARDEN_MENU)


def is_softgarden_menu_sql(c: str) -> str:
    return matches_sql(c, SOFTGARDEN_MENU)


def is_join_menu(c: Column) -> Column:
    """F8: the same for the other board."""
    return matches(c, JOIN_MENU)


def is_join_menu_sql(c: str) -> str:
    return matches_sql(c, JOIN_MENU)


def on_listing(c: Column) -> Column:
    """already on a list of postings: a known platform, a query or a listing path."""
    return platform(c).isNotNull() | F.contains(c, F.lit("?")) | matches(c, LISTING_PATHS)


def on_listing_sql(c: str) -> str:
    return f"({platform_sql(c)} IS NOT NULL OR contains({c}, '?') OR {matches_sql(c, LISTING_PATHS)})"


def is_single_posting(c: Column) -> Column:
    """links to one posting, not to a list."""
    return matches(c, SINGLE_POSTING)


def is_single_posting_sql(c: str) -> str:
    return matches_sql(c, SINGLE_POSTING)


def is_redirect(c: Column, final: Column) -> Column:
    """another host, www. and case aside."""
    return bare_host(c) != bare_host(final)


def is_redirect_sql(c: str, final: str) -> str:
    return f"{bare_host_sql(c)} <> {bare_host_sql(final)}"


def search_url(base: str, keywords: Column, place: Column | None, page: Column) -> Column:
    """A job site's search URL; the page shows from the second on."""
    out = F.concat(F.lit(base), keywords)
    out = out if place is None else F.concat(out, F.lit("/in-"), place)
    return F.concat(out, F.when(page > 0, F.concat(F.lit("?page="), (page + 1).cast("string"))).otherwise(""))


def search_url_sql(base: str, keywords: str, place: str | None, page: str) -> str:
    mid = f" || '/in-' || {place}" if place else ""
    return f"'{base}' || {keywords}{mid} || CASE WHEN {page} > 0 THEN '?page=' || ({page} + 1) ELSE '' END"


def chosen_careers_url(sitemap: Column, nav: Column) -> Column:
    """T5: sitemap against navigation: a list beats a posting, a shorter path a
    longer, a short last part one of over 20 characters; else the sitemap."""
    parts = lambda c: F.filter(F.split(path(c), "/"), lambda s: s != "")
    last = lambda c: F.coalesce(F.try_element_at(parts(c), F.lit(-1)), F.lit(""))
    listing = lambda c: F.lower(last(c)).isin(LISTING_WORDS)
    return (
        F.when(F.coalesce(sitemap, F.lit("NOT_FOUND")).isin("", "NOT_FOUND"), nav)
        .when(F.coalesce(nav, F.lit("")) == "", sitemap)
        .when(listing(nav) & ~listing(sitemap), nav)
        .when(listing(sitemap) & ~listing(nav), sitemap)
        .when(F.size(parts(nav)) < F.size(parts(sitemap)), nav)
        .when((F.length(last(sitemap)) > 20) & (F.length(last(nav)) <= 20), nav)
        .otherwise(sitemap)
    )


def chosen_careers_url_sql(sitemap: str, nav: str) -> str:
    parts = lambda c: f"list_filter(string_split({path_sql(c)}, '/'), lambda s: s <> '')"
    last = lambda c: f"coalesce({parts(c)}[-1], '')"
    listing = lambda c: f"lower({last(c)}) IN ({listed(LISTING_WORDS)})"
    return (
        f"CASE WHEN coalesce({sitemap}, 'NOT_FOUND') IN ('', 'NOT_FOUND') THEN {nav} WHEN coalesce({nav}, '') = '' THEN {sitemap} "
        f"WHEN {listing(nav)} AND NOT {listing(sitemap)} THEN {nav} WHEN {listing(sitemap)} AND NOT {listing(nav)} THEN {sitemap} "
        f"WHEN len({parts(nav)}) < len({parts(sitemap)}) THEN {nav} WHEN length({last(sitemap)}) > 20 AND length({last(nav)}) <= 20 THEN {nav} ELSE {sitemap} END"
    )

"""Scalar functions over titles, locations and other short texts.

Every function ``f(c)`` has a twin ``f_sql(expr)`` for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import contains_any, contains_any_sql, lookup, lookup_sql, matches, matches_sql, once, quote, rewrite, rewrite_sql, without_tails

# --- fixed values --------------------------------------------------------------

GENDER = [(r"\s*\([mwfdx/]+\)\s*", " "), (r"\s+[mwfdx]/[mwfdx](/[mwfdx])?\s*$", "")]
SPACES = [(r"\s+", " ")]
COUNTRIES = ["deutschland", "germany", "österreich", "austria", "schweiz", "switzerland"]
MORE_COUNTRIES = [*COUNTRIES, r"united\s*kingdom", "uk", "usa", r"united\s*states", "netherlands", "france", "spain", "italy", "poland"]
EMPLOYMENT = ["vollzeit", "teilzeit", r"inkl\.?\s*home\s*office"]
MORE_EMPLOYMENT = ["vollzeit", "teilzeit", r"full[\s-]*time", r"part[\s-]*time", "remote", "hybrid", r"inkl\.?\s*home\s*office"]
ADVERT = [r"job\s*advert", r"job\s*posting", "stellenanzeige", r"job\s*offer", "vacancy", r"apply\s*now"]
NO_LOCATION = ["unknown", "n/a", "na", "none", "-", ""]
NON_JOB = [
    "initiativbewerbung", r"initiativ\s*bewerbung", "spontanbewerbung", r"open\s*application",
    r"unsolicited\s*application", r"speculative\s*application", r"general\s*application", "blindbewerbung",
]
SINGULAR = [
    ("telefonisten", "telefonist"), ("mitarbeiterin", "mitarbeiter"), ("mitarbeiterinnen", "mitarbeiter"),
    ("assistentin", "assistent"), ("assistentinnen", "assistent"), ("beraterinnen", "berater"), ("beraterin", "berater"),
    ("kundenbetreuerin", "kundenbetreuer"), ("kundenbetreuerinnen", "kundenbetreuer"),
]
TRANSLATION = [
    ("systemadministrator", "System Administrator"), ("teamleitung", "Team Lead"), ("teamleiter", "Team Lead"),
    ("abteilungsleiter", "Department Head"), ("geschäftsführer", "Managing Director"), ("projektleiter", "Project Manager"),
    ("produktmanager", "Product Manager"), ("kundenservice", "Customer Service"), ("kundendienst", "Customer Service"),
    ("werkstudent", "Working Student"), ("auszubildende[r]?", "Apprentice"), ("praktikantin", "Intern"),
    ("praktikant", "Intern"), ("stellvertretender?", "Deputy"), ("kauffrau", "Commercial Clerk"), ("kaufmann", "Commercial Clerk"),
    ("entwickler", "Developer"), ("ingenieur", "Engineer"), ("referent", "Specialist"), ("berater", "Consultant"),
    ("analyst", "Analyst"), ("architekt", "Architect"), ("spezialist", "Specialist"), ("fachkraft", "Specialist"),
    ("experte", "Expert"), ("meister", "Master"), ("techniker", "Technician"), ("assistentin", "Assistant"),
    ("assistent", "Assistant"), ("sachbearbeiter", "Clerk"), ("mitarbeiter", "Employee"), ("leiter", "Lead"),
    (" für ", " for "), (" und ", " and "), (" oder ", " or "), (" im ", " in "), (" bei ", " at "), (" interne ", " internal "),
    ("vollzeit", "Full-time"), ("teilzeit", "Part-time"),
]
NON_ENGLISH = [
    "entwickler", "ingenieur", "leiter", "berater", "kaufmann", "kauffrau", "sachbearbeiter", "mitarbeiter", "fachkraft",
    "meister", "techniker", "stellvertretender", "geschäftsführer", "abteilungsleiter", "werkstudent",
    "практикант", "разработчик", "инженер", "менеджер",
]
TITLE_WORDS = [
    "manager", "developer", "engineer", "consultant", "analyst", "designer", "director", "specialist", "coordinator",
    "assistant", "administrator", "architect", "lead", "senior", "junior", "intern", "trainee", "head", "chief", "officer",
    "president", "vice", "leiter", "leiterin", "berater", "beraterin", "entwickler", "entwicklerin", "ingenieur",
    "ingenieurin", "fachkraft", "mitarbeiter", "mitarbeiterin", "werkstudent", "werkstudentin", "praktikant",
    "praktikantin", "geschäftsführer", "geschäftsführerin", "projektmanager", "projektmanagerin", "produktmanager",
    "produktmanagerin", "teamleiter", "teamleiterin", "sachbearbeiter", "sachbearbeiterin", "referent", "referentin",
    "kaufmann", "kauffrau", "techniker", "technikerin",
]
NON_TITLE_WORDS = [
    "impressum", "datenschutz", "privacy", "cookie", "agb", "terms", "copyright", "all rights reserved",
    "alle rechte vorbehalten", "kontakt", "contact", "über uns", "about", "home", "startseite", "login", "register",
    "anmelden", "registrieren", "suche", "search", "newsletter", "blog", "news", "presse", "press", "mehr erfahren",
    "learn more", "read more", "weiterlesen", "zurück", "back", "filter", "sort", "alle", "all", "reset", "clear",
    "download anfordern", "entdecken sie", "consent", "storage duration", "pixel tracker", "local storage", "persistent",
    "preferences", "statistics", "cross-domain", "necessary", "tracking", "data subject", "rights form", "speakup",
    "do not sell", "share my personal", "dokumentenverwaltung", "finanzen & controlling", "finanzen und controlling",
    "geräte- und maschinenverwaltung", "service und wartung", "vertrieb und crm", "wohnbau-management", "einkauf, lager",
]
COMPANY_NAMES = [r"\blimited\b", r"\bgmbh\b", r"\b[A-Z][a-z]+\s+AG\b", r"\bbv\b", r"\bbuilding\s+services\b", r"^[A-Z]{2,}\s+International$"]
NON_TITLES = [
    r"^type:\s*", "^maximum storage", r"\.com\d*$", "©", r"^\s*$", r"^[a-z0-9.-]+\.[a-z]{2,4}$",
    r"^(html\s+)?local\s+storage$", r"^\d+\s*(year|month|day)s?$", "^session$",
]
NAVIGATION = ["home", "back", "next", "previous", "menu"]
CITIES_DE = {
    "berlin": "berlin", "берлин": "berlin", "munich": "muenchen", "münchen": "muenchen", "мюнхен": "muenchen",
    "frankfurt": "frankfurt-am-main", "франкфурт": "frankfurt-am-main", "hamburg": "hamburg", "гамбург": "hamburg",
    "cologne": "koeln", "köln": "koeln", "кёльн": "koeln", "düsseldorf": "duesseldorf", "дюссельдорф": "duesseldorf",
    "stuttgart": "stuttgart", "штутгарт": "stuttgart", "dortmund": "dortmund", "essen": "essen", "leipzig": "leipzig",
    "bremen": "bremen", "dresden": "dresden", "hannover": "hannover", "nuremberg": "nuernberg", "nürnberg": "nuernberg",
}
CITIES_AT = {
    "vienna": "wien", "wien": "wien", "вена": "wien", "graz": "graz", "грац": "graz", "linz": "linz", "линц": "linz",
    "salzburg": "salzburg", "зальцбург": "salzburg", "innsbruck": "innsbruck", "инсбрук": "innsbruck",
    "klagenfurt": "klagenfurt", "клагенфурт": "klagenfurt", "austria": "oesterreich", "österreich": "oesterreich", "австрия": "oesterreich",
}
AREAS = {
    "москва": "1", "moscow": "1", "санкт-петербург": "2", "saint-petersburg": "2", "spb": "2", "новосибирск": "4",
    "екатеринбург": "3", "казань": "88", "нижний новгород": "66", "россия": "113", "russia": "113",
}
EXPERIENCE = {"no_experience": "noExperience", "1-3": "between1And3", "3-6": "between3And6", "6+": "moreThan6"}
BASE_CONFIDENCE = {"schema_org": 0.95, "pdf_link": 0.90, "llm": 0.70}
SIGNALS = {
    "has_gender_notation": 0.15, "has_job_url": 0.10, "has_location": 0.05, "title_has_keywords": 0.10,
    "in_job_container": 0.08, "proper_length": 0.05, "too_long": -0.20, "too_short": -0.15, "looks_like_nav": -0.30,
    "has_non_job_words": -0.25,
}
TOP_DOMAINS = "com|ru|org|net|io|co|tech"

# --- titles and locations ------------------------------------------------------


def _tails(words: list[str], lead: str = r",?\s*") -> list[tuple[str, str]]:
    return [(lead + w + r"\s*$", "") for w in words]


def _base(c: Column) -> Column:
    return F.trim(F.lower(c))


def _base_sql(c: str) -> str:
    return f"trim(lower({c}))"


def _tidy(c: Column) -> Column:
    # single blanks, which stay as they are, aren't matched
    return F.trim(rewrite(c, [(r"\s{2,}|[\s&&[^ ]]", " ")]))


def _tidy_sql(c: str) -> str:
    return f"trim({rewrite_sql(c, SPACES)})"


def normalize_title(c: Column) -> Column:
    """V1: title for de-duplication, without gender notation."""
    return _tidy(rewrite(_base(c), GENDER))


def normalize_title_sql(c: str) -> str:
    return _tidy_sql(rewrite_sql(_base_sql(c), GENDER))


_PLACES = [*COUNTRIES, *EMPLOYMENT]
_MORE_PLACES = [*MORE_COUNTRIES, *MORE_EMPLOYMENT]


def _no_comma(c: Column) -> Column:
    return F.trim(F.rtrim(c, F.lit(",")))


def normalize_location(c: Column) -> Column:
    """V2: location for de-duplication; each suffix is tried once, in order."""
    return _no_comma(_tidy(without_tails(_base(c), _PLACES, r",?\s*")))


def normalize_location_sql(c: str) -> str:
    return f"trim(rtrim({_tidy_sql(rewrite_sql(_base_sql(c), _tails(_PLACES)))}, ','))"


def sync_title(c: Column) -> Column:
    """V3: title as the snapshot key; advert suffixes go before gender notation."""
    return _tidy(rewrite(without_tails(_base(c), ADVERT, r"\s*"), GENDER))


def sync_title_sql(c: str) -> str:
    return _tidy_sql(rewrite_sql(_base_sql(c), _tails(ADVERT, r"\s*") + GENDER))


def sync_location(c: Column) -> Column:
    """V4: location as the snapshot key; unknown and null are empty."""
    base = _base(c)
    return F.when(c.isNull() | base.isin(NO_LOCATION), "").otherwise(_no_comma(_tidy(without_tails(base, _MORE_PLACES, r",?\s*"))))


def sync_location_sql(c: str) -> str:
    none = ", ".join(map(quote, NO_LOCATION))
    return f"CASE WHEN {c} IS NULL OR {_base_sql(c)} IN ({none}) THEN '' ELSE trim(rtrim({_tidy_sql(rewrite_sql(_base_sql(c), _tails(_MORE_PLACES)))}, ',')) END"


_CANDIDATE = [
    (r"\s*\([mwfdx/]+\)\s*", ""),
    (r"\s*[mwfdx]/[mwfdx](/[mwfdx])?\s*$", ""),
    (r"\s*[–-]\s*(vollzeit|teilzeit|full-?time|part-?time)[:/]?\s*[\d.,\s-]*(euro|eur|€)?.*$", ""),
    (r"\s*[\d.,]+\s*[-–]\s*[\d.,]+\s*(euro|eur|€)\s*(jahresgehalt|annual|salary)?\.?\s*$", ""),
    (r"\s+in\s+(vollzeit|teilzeit)\b", ""),
    (r"\s+(im|in der|in den|für)\s+\w+$", ""),
]
_CANDIDATE_WORDS = [
    *[(rf"\b{a}\b", b) for a, b in SINGULAR],
    (r"\bdes\s+geschäftsführers\b", "der geschäftsführung"),
    (r"\bgeschäftsführers\b", "geschäftsführung"),
]


def candidate_title(c: Column) -> Column:
    """V6: title of a candidate for comparison, repeats undone first."""
    any_word = rf"\b(?:{'|'.join(a for a, _ in SINGULAR)}|geschäftsführers)\b"
    plain = rewrite(F.lower(unrepeated(c)), _CANDIDATE)
    worded = once(plain, lambda x: F.when(matches(x, [any_word]), rewrite(x, _CANDIDATE_WORDS)).otherwise(x))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(_tidy(worded))


def candidate_title_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE {_tidy_sql(rewrite_sql(f'lower({unrepeated_sql(c)})', _CANDIDATE))} END"


def unrepeated(c: Column) -> Column:
    """V7: undo titles that are repeated by lines or end to end."""
    lines = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda x: x != "")
    unique = F.array_distinct(lines)
    plain = lambda x: _tidy(F.lower(x))
    by_lines = F.when(
        F.contains(c, F.lit("\n")),
        F.when(F.size(unique) < F.size(lines), F.array_join(unique, " ")).when(
            (F.size(lines) >= 2) & (rewrite(F.lower(lines[0]), SPACES) == rewrite(F.lower(lines[1]), SPACES)), lines[0]
        ),
    )
    n = F.length(c)
    points = F.sequence(F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"))
    halves = F.filter(
        points,
        lambda i: (F.substring(c, i + 1, n) == F.substring(c, F.lit(1), i))
        | ((plain(F.substring(c, i + 1, n)) == plain(F.substring(c, F.lit(1), i))) & (plain(F.substring(c, F.lit(1), i)) != "")),
    )

    def doubled(x: Column) -> Column:
        half = (F.length(x) / 2).cast("int")
        return F.substring(x, F.lit(1), half) == F.substring(x, half + 1, half + 1)

    # whatever the cut, equal halves are equal without their blanks; a last sigma has a small letter of its own
    may_repeat = once(F.translate(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), "ς", "σ"), doubled)
    by_half = F.when(may_repeat, F.when(F.size(halves) > 0, F.trim(F.substring(c, F.lit(1), halves[0]))))
    return F.when(n < 10, c).otherwise(F.coalesce(by_lines, by_half, c))


def unrepeated_sql(c: str) -> str:
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    half = lambda a: _tidy_sql(f"lower({a})")
    head, rest = f"substr({c}, 1, i)", f"substr({c}, i + 1)"
    # ordered distinct: keep an element if it is the first of its kind
    unique = f"list_filter({lines}, lambda x, k: list_position({lines}, x) = k)"
    points = f"list_filter(range(length({c}) // 4, length({c}) // 2 + 1), lambda i: {rest} = {head} OR ({half(rest)} = {half(head)} AND {half(head)} <> ''))"
    return (
        f"CASE WHEN length({c}) < 10 THEN {c} WHEN len({unique}) < len({lines}) THEN array_to_string({unique}, ' ') "
        f"WHEN len({lines}) >= 2 AND {rewrite_sql(f'lower({lines}[1])', SPACES)} = {rewrite_sql(f'lower({lines}[2])', SPACES)} THEN {lines}[1] "
        f"WHEN len({points}) > 0 THEN trim(substr({c}, 1, ({points})[1])) ELSE {c} END"
    )


def is_open_application(c: Column) -> Column:
    """entries that aren't a job; an empty title is not one of them."""
    return F.coalesce(matches(c, NON_JOB), F.lit(False))


def is_open_application_sql(c: str) -> str:
    return f"coalesce({matches_sql(c, NON_JOB)}, false)"


def title_verdict(c: Column) -> Column:
    """why a text is or isn't a likely job title."""
    low = _base(c)
    return (
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty")
        .when(F.length(c) < 5, "too_short")
        .when(F.length(c) > 150, "too_long")
        .when(matches(low, NON_TITLES), "non_job_pattern")
        .when(contains_any(low, NON_TITLE_WORDS), "non_job_words")
        .when(matches(c, COMPANY_NAMES), "company_name")
        .when(low.isin(NAVIGATION), "nav")
        .when(low.rlike(r"\([mwfdx/]+\)"), "gender_notation")
        .when(matches(low, [rf"\b{w}\b" for w in TITLE_WORDS]), "keywords")
        .otherwise("no_signal")
    )


def title_verdict_sql(c: str) -> str:
    low = _base_sql(c)
    nav = ", ".join(map(quote, NAVIGATION))
    return (
        f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'empty' WHEN length({c}) < 5 THEN 'too_short' WHEN length({c}) > 150 THEN 'too_long' "
        f"WHEN {matches_sql(low, NON_TITLES)} THEN 'non_job_pattern' WHEN {contains_any_sql(low, NON_TITLE_WORDS)} THEN 'non_job_words' "
        f"WHEN {matches_sql(c, COMPANY_NAMES)} THEN 'company_name' WHEN {low} IN ({nav}) THEN 'nav' "
        f"WHEN regexp_matches({low}, '\\([mwfdx/]+\\)') THEN 'gender_notation' "
        + "WHEN " + matches_sql(low, [rf"\b{w}\b" for w in TITLE_WORDS]) + " THEN 'keywords' ELSE 'no_signal' END"
    )


def translated(c: Column) -> Column:
    """Dictionary translation, rules in order on substrings."""
    return F.when(matches(c, [p for p, _ in TRANSLATION]), rewrite(c, TRANSLATION)).otherwise(c)


def translated_sql(c: str) -> str:
    return rewrite_sql(c, TRANSLATION)


def looks_english(c: Column) -> Column:
    """F20 for one title; a batch looks English if all of its titles do."""
    return ~(c.rlike("[äöüßÄÖÜ]") | contains_any(F.lower(c), NON_ENGLISH))


def looks_english_sql(c: str) -> str:
    return f"NOT (regexp_matches({c}, '[äöüßÄÖÜ]') OR {contains_any_sql(f'lower({c})', NON_ENGLISH)})"


_UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]


def slug(c: Column) -> Column:
    """V9: lower-case, umlauts spelled out, the rest to single hyphens."""
    out = F.lower(c)
    for a, b in _UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(out, "[^a-z0-9]+", "-"), F.lit("-"))


def slug_sql(c: str) -> str:
    out = f"lower({c})"
    for a, b in _UMLAUTS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', '-', 'g'), '-')"


def location_slug(c: Column, cities: dict[str, str]) -> Column:
    """A known city's slug, else the text's."""
    return lookup(_base(c), cities, slug(c))


def location_slug_sql(c: str, cities: dict[str, str]) -> str:
    return lookup_sql(_base_sql(c), cities, slug_sql(c))


def salary_display(low: Column, high: Column, currency: Column) -> Column:
    """Zero counts as missing; the default currency is RUB."""
    a, b = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))
    unit = F.coalesce(F.nullif(currency, F.lit("")), F.lit("RUB"))
    fmt = lambda x: F.format_number(x, 0)
    return (
        F.when((a == 0) & (b == 0), "Не указана")
        .when((a != 0) & (b != 0), F.concat(fmt(a), F.lit(" - "), fmt(b), F.lit(" "), unit))
        .when(a != 0, F.concat(F.lit("от "), fmt(a), F.lit(" "), unit))
        .otherwise(F.concat(F.lit("до "), fmt(b), F.lit(" "), unit))
    )


def salary_display_sql(low: str, high: str, currency: str) -> str:
    a, b, unit = f"coalesce({low}, 0)", f"coalesce({high}, 0)", f"coalesce(nullif({currency}, ''), 'RUB')"
    fmt = lambda x: f"format('{{:,}}', {x}::BIGINT)"
    return (
        f"CASE WHEN {a} = 0 AND {b} = 0 THEN 'Не указана' WHEN {a} <> 0 AND {b} <> 0 THEN {fmt(a)} || ' - ' || {fmt(b)} || ' ' || {unit} "
        f"WHEN {a} <> 0 THEN 'от ' || {fmt(a)} || ' ' || {unit} ELSE 'до ' || {fmt(b)} || ' ' || {unit} END"
    )


def title_signals(c: Column) -> Column:
    """What speaks for a text as a title and what against it."""
    listed = F.array(*map(F.lit, TITLE_WORDS))
    blank = F.lit(" ")

    def told(low: Column, words: Column) -> Column:
        bad = F.filter(F.array(*map(F.lit, NON_TITLE_WORDS)), lambda w: F.contains(low, w))
        n = F.length(F.trim(c))
        return F.struct(
            low.rlike(r"\([mwfdx/]+\)").alias("has_gender_notation"), (F.size(words) > 0).alias("title_has_keywords"), F.array_join(F.slice(words, 1, 3), ",").alias("matched_keywords"),
            ((n > 15) & (n < 100)).alias("proper_length"), (n < 5).alias("too_short"), (n > 150).alias("too_long"), (F.size(bad) > 0).alias("has_non_job_words"),
            low.isin(NAVIGATION).alias("looks_like_nav"), matches(c, COMPANY_NAMES).alias("looks_like_company_name"),
        )

    # the text is rewritten once, not for each word that is looked for
    padded = lambda low: F.concat(blank, F.regexp_replace(low, r"(?U)[^\w]+", " "), blank)
    found = lambda p: F.filter(listed, lambda w: F.contains(p, F.concat(blank, w, blank)))
    return once(_base(c), lambda low: once(once(padded(low), found), lambda words: told(low, words)))


def title_signals_sql(c: str) -> dict[str, str]:
    low = _base_sql(c)
    listed = lambda v: "[" + ", ".join(map(quote, v)) + "]"
    words = f"list_filter({listed(TITLE_WORDS)}, lambda w: contains(' ' || regexp_replace({low}, '[^\\pL\\pN_]+', ' ', 'g') || ' ', ' ' || w || ' '))"
    bad = f"list_filter({listed(NON_TITLE_WORDS)}, lambda w: contains({low}, w))"
    return {
        "has_gender_notation": f"regexp_matches({low}, '\\([mwfdx/]+\\)')", "title_has_keywords": f"len({words}) > 0", "matched_keywords": f"array_to_string(({words})[1:3], ',')",
        "proper_length": f"length(trim({c})) > 15 AND length(trim({c})) < 100", "too_short": f"length(trim({c})) < 5", "too_long": f"length(trim({c})) > 150",
        "has_non_job_words": f"len({bad}) > 0", "looks_like_nav": f"{low} IN ({', '.join(map(quote, NAVIGATION))})", "looks_like_company_name": matches_sql(c, COMPANY_NAMES),
    }


def good_translations(titles: Column, translated_: Column) -> Column:
    """as many answers as titles, none of them spoilt."""
    return (F.size(titles) == F.size(translated_)) & F.forall(translated_, lambda x: ~bad_translation(x))


def confidence(source: Column, signals: dict[str, Column]) -> Column:
    """Base of the source plus weights of its signals, within [0, 1]."""
    base = F.lit(0.5)
    for k, v in BASE_CONFIDENCE.items():
        base = F.when(source == k, v).otherwise(base)
    bonus = sum((F.when(F.coalesce(signals[k], F.lit(False)), F.lit(w)).otherwise(0.0) for k, w in SIGNALS.items() if k in signals), F.lit(0.0))
    return F.round(F.least(F.greatest(base + bonus, F.lit(0.0)), F.lit(1.0)), 6)


def confidence_sql(source: str, signals: dict[str, str]) -> str:
    base = "CASE " + " ".join(f"WHEN {source} = '{k}' THEN {v}::DOUBLE" for k, v in BASE_CONFIDENCE.items()) + " ELSE 0.5::DOUBLE END"
    bonus = " + ".join(f"CASE WHEN coalesce({signals[k]}, false) THEN {w}::DOUBLE ELSE 0::DOUBLE END" for k, w in SIGNALS.items() if k in signals)
    return f"round(least(greatest({base} + {bonus or '0'}, 0), 1), 6)"


def cache_key(namespace: Column, content: Column, model: Column) -> Column:
    """First 32 hex digits of the sha-256 of namespace, model and content."""
    return F.left(F.sha2(F.concat_ws(":", namespace, F.coalesce(model, F.lit("default")), content), 256), F.lit(32))


def cache_key_sql(namespace: str, content: str, model: str) -> str:
    return f"left(sha256({namespace} || ':' || coalesce({model}, 'default') || ':' || {content}), 32)"


def company_name(host: Column) -> Column:
    """Host without www. and top domain, a capital after each non-letter."""
    base = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), rf"\.({TOP_DOMAINS})$", "")
    words = F.split(F.lower(base), r"(?<=[^a-z])|(?=[^a-z])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 200))), "")


def company_name_sql(host: str) -> str:
    base = f"lower(regexp_replace(regexp_replace({host}, '^www\\.', ''), '\\.({TOP_DOMAINS})$', ''))"
    words = f"regexp_extract_all({base}, '[a-z]+|[^a-z]')"
    return f"array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || substr(w, 2)), '')"


ACRONYMS = ["it", "hr", "qa", "pr", "vp", "ceo", "cto", "cfo", "sap", "erp", "crm"]
STRIP_WORDS = [
    "stellenausschreibung", "stellenangebot", "stellenanzeige", "jobausschreibung", "jobangebot", "jobanzeige",
    "karriere", "career", "vacancy", "position", "job", "posting", "job_posting", "jobposting",
]


def filename_title(c: Column) -> Column:
    """V8: a title from a document's file name."""
    name = F.regexp_replace(c, r"\.[^.]*$", "")
    name = F.regexp_replace(name, r"([a-zA-ZäöüÄÖÜß])-([a-zA-ZäöüÄÖÜß])", "$1§$2")
    name = F.replace(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")), F.lit("§"), F.lit("-"))
    kept = F.filter(
        F.split(F.trim(name), r"\s+"),
        lambda p: ~p.rlike(r"^\d{6,8}$")
        & ~F.lower(p).rlike(r"^v\d+$")
        & ~p.rlike(r"^\d+[a-zA-Z]+$")
        & ~F.lower(p).isin(STRIP_WORDS)
        & ((F.length(p) > 2) | F.lower(p).isin(ACRONYMS[:5])),
    )
    short = lambda s: F.lower(s).isin(ACRONYMS) | ((F.upper(s) == s) & (F.length(s) <= 4))
    cased = lambda s: F.when(short(s), F.upper(s)).otherwise(F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 500))))
    return F.array_join(F.transform(kept, lambda p: F.when(short(p), F.upper(p)).otherwise(F.array_join(F.transform(F.split(p, "-"), cased), "-"))), " ")


def filename_title_sql(c: str) -> str:
    name = f"regexp_replace({c}, '\\.[^.]*$', '')"
    name = f"regexp_replace({name}, '([a-zA-ZäöüÄÖÜß])-([a-zA-ZäöüÄÖÜß])', '\\1§\\2', 'g')"
    name = f"replace(replace(replace({name}, '_', ' '), '-', ' '), '§', '-')"
    listed = lambda w: ", ".join(map(quote, w))
    kept = (
        f"list_filter(string_split_regex(trim({name}), '\\s+'), lambda p: NOT regexp_matches(p, '^\\d{{6,8}}$') AND NOT regexp_matches(lower(p), '^v\\d+$') "
        f"AND NOT regexp_matches(p, '^\\d+[a-zA-Z]+$') AND lower(p) NOT IN ({listed(STRIP_WORDS)}) AND (length(p) > 2 OR lower(p) IN ({listed(ACRONYMS[:5])})))"
    )
    short = lambda s: f"(lower({s}) IN ({listed(ACRONYMS)}) OR (upper({s}) = {s} AND length({s}) <= 4))"
    cased = f"CASE WHEN {short('s')} THEN upper(s) ELSE upper(left(s, 1)) || lower(substr(s, 2)) END"
    return f"array_to_string(list_transform({kept}, lambda p: CASE WHEN {short('p')} THEN upper(p) ELSE array_to_string(list_transform(string_split(p, '-'), lambda s: {cased}), '-') END), ' ')"


# --- parts of board texts ------------------------------------------------------------


def without_badge(c: Column) -> Column:
    """A title without a trailing "New" or "Neu" badge of its own."""
    return F.trim(F.regexp_replace(c, r"\s*\b(?:New|Neu)\s*$", ""))


def without_badge_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s*\\b(?:New|Neu)\\s*$', ''))"


SPLIT = r"^(.+?)\s*[|–—-]\s*([A-Z][^|–—-]+)$"


def split_title(c: Column) -> Column:
    """(title, location) of "title - Location"; else Unknown."""
    return F.when(c.rlike(SPLIT), F.struct(F.trim(F.regexp_extract(c, SPLIT, 1)).alias("title"), F.trim(F.regexp_extract(c, SPLIT, 2)).alias("location"))).otherwise(
        F.struct(c.alias("title"), F.lit("Unknown").alias("location"))
    )


def split_title_sql(c: str) -> tuple[str, str]:
    m = f"regexp_matches({c}, '{SPLIT}')"
    return f"CASE WHEN {m} THEN trim(regexp_extract({c}, '{SPLIT}', 1)) ELSE {c} END", f"CASE WHEN {m} THEN trim(regexp_extract({c}, '{SPLIT}', 2)) ELSE 'Unknown' END"


def first_part(c: Column, sep: str = " - ") -> Column:
    """The first part of "unit - level - contract"."""
    return F.trim(F.split_part(c, F.lit(sep), F.lit(1)))


def first_part_sql(c: str, sep: str = " - ") -> str:
    return f"trim(split_part({c}, '{sep}', 1))"


#: Fixed values.
TRANSIENT = ["provider returned error", "rate limit", "overloaded", "capacity", "temporarily unavailable", "service unavailable", "internal server error", "502", "503", "504"]


def is_transient(c: Column) -> Column:
    """an error that may pass."""
    return contains_any(F.lower(c), TRANSIENT)


def is_transient_sql(c: str) -> str:
    return contains_any_sql(f"lower({c})", TRANSIENT)


def bad_translation(c: Column) -> Column:
    """marks of a spoilt answer."""
    return F.contains(c, F.lit("\xa0?")) | F.contains(c, F.lit("\\xa0")) | (c == "...") | F.contains(F.lower(c), F.lit("error"))


def bad_translation_sql(c: str) -> str:
    return f"(contains({c}, chr(160) || '?') OR contains({c}, '\\xa0') OR {c} = '...' OR contains(lower({c}), 'error'))"


def quoted_url(c: Column, base: Column) -> Column:
    """The first http(s) URL of a text, else a quoted path on the base."""
    url = F.regexp_replace(F.regexp_extract(c, r"(https?://[^\s\"'<>)\]]+)", 1), "[.,;:]+$", "")
    path = F.regexp_extract(c, r"[\"'](/[^\"'\s]*)[\"']", 1)
    return F.when(url != "", url).when(path != "", F.concat(F.rtrim(base, F.lit("/")), path))


def quoted_url_sql(c: str, base: str) -> str:
    url = f"regexp_replace(regexp_extract({c}, '(https?://[^\\s\"''<>)\\]]+)', 1), '[.,;:]+$', '')"
    path = f"regexp_extract({c}, '[\"''](/[^\"''\\s]*)[\"'']', 1)"
    return f"CASE WHEN {url} <> '' THEN {url} WHEN {path} <> '' THEN rtrim({base}, '/') || {path} END"


def _balanced(c: Column) -> Column:
    """From the first object (one with jobs, if there is one) to the brace that
    closes it; braces within texts count too."""
    begins = [F.nullif(F.locate(b, c), F.lit(0)) for b in ('{"jobs"', '{ "jobs"', "{")]
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(a: Column, ch: Column) -> Column:
        n = a["n"] + 1
        depth = a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.struct(n.alias("n"), depth.alias("depth"), F.when((a["end"] == 0) & (ch == "}") & (depth == 0), n).otherwise(a["end"]).alias("end"))

    rest = F.array(F.substring(c, F.coalesce(*begins), F.length(c)))

    def cut(x: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(x, F.lit("(?s)(.)"), 1), first, step)["end"]
        return F.substring(x, F.lit(1), end)

    return F.transform(rest, cut)[0]


def _is_json(x: Column) -> Column:
    """One JSON value and nothing behind it, which the parser alone lets pass: it
    must also stand as the only member of a list and of an object."""
    alone = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
    return (F.trim(F.coalesce(x, F.lit(""))) != "") & member.isNotNull() & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()


def answer_json(c: Column) -> Column:
    """The JSON of an answer: a fenced block, the whole text, the first
    object with its braces balanced, the widest list, else an empty list."""
    good = lambda x: F.when(_is_json(x), x)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(good(F.trim(fenced)), good(F.trim(c)), good(F.when(F.contains(c, F.lit("{")), _balanced(c))), good(F.regexp_extract(c, r"(?s)(\[.*\])", 1)), F.lit("[]"))


def answer_json_sql(c: str) -> str:
    good = lambda x: f"CASE WHEN coalesce({x}, '') <> '' AND json_valid({x}) THEN {x} END"
    begin = " ".join(f"WHEN contains({c}, '{b}') THEN substr({c}, strpos({c}, '{b}'))" for b in ('{"jobs"', '{ "jobs"', "{"))
    rest = f"(CASE {begin} END)"
    count = lambda ch: f"length(replace(substr({rest}, 1, i), '{ch}', ''))"
    object_ = f"substr({rest}, 1, coalesce(list_filter(range(1, length({rest}) + 1), lambda i: {count('{')} = {count('}')})[1], 0))"
    return (
        f"coalesce({good(f"trim(regexp_extract({c}, '(?s)```(?:json)?[[:space:]]*(.*?)[[:space:]]*```', 1))")}, {good(f'trim({c})')}, "
        f"CASE WHEN contains({c}, '{{') THEN {good(object_)} END, {good(f"regexp_extract({c}, '(?s)(\\[.*\\])', 1)")}, '[]')"
    )


def parsed_time(c: Column) -> Column:
    """A stored time, or null where it can't be read."""
    return F.try_to_timestamp(c)


def parsed_time_sql(c: str) -> str:
    return f"try_cast({c} AS TIMESTAMP)"


def report_day(c: Column) -> Column:
    """The day of a stored time; what can't be read gives its first ten characters."""
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.date_format(parsed_time(c), "yyyy-MM-dd"), F.substring(c, 1, 10)))


def report_day_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'Unknown' ELSE coalesce(strftime({parsed_time_sql(c)}, '%Y-%m-%d'), substr({c}, 1, 10)) END"


def report_clock(c: Column) -> Column:
    """Its hour and minute, else nothing."""
    return F.coalesce(F.date_format(parsed_time(F.coalesce(c, F.lit(""))), "HH:mm"), F.lit(""))


def report_clock_sql(c: str) -> str:
    return f"coalesce(strftime({parsed_time_sql(c)}, '%H:%M'), '')"


def answer_content(response: Column) -> Column:
    """What a model said, in a chat answer; nothing is the empty text."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(""))


def answer_content_sql(c: str) -> str:
    return f"coalesce(json_extract_string({c}, '$.choices[0].message.content'), '')"


def is_empty_result(answer: Column) -> Column:
    """An answer without jobs, which is asked for again."""
    return F.coalesce(F.get_json_object(answer, "$.jobs").isin("[]", "", "0", "false", "{}"), F.lit(True))


def is_empty_result_sql(c: str) -> str:
    return f"coalesce(json_extract_string({c}, '$.jobs') IN ('[]', '', '0', 'false', '{{}}'), true)"


def http_date(c: Column) -> Column:
    """V29 for the date form."""
    return F.try_to_timestamp(F.substring(c, 6, 100), F.lit("dd MMM yyyy HH:mm:ss zzz"))

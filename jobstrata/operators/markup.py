"""HTML for readers: cleaned markup, Markdown, and the section with the jobs."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dom import VOID, Node, parse

# --- fixed values ----------------------------------------------------------------
DROPPED = ("script", "style", "svg", "noscript", "head", "meta", "link", "iframe")
CONSENT = '[role="dialog"], [id*=cookie], [id*=consent], [class*=cookie], [class*=consent], [id*=gdpr], [class*=gdpr], [id*=CookieBot], [class*=CookieBot]'
KEPT_ATTRS = ("href", "class", "id", "role", "data-job", "data-position")
CLASS_WORDS = ("job", "career", "position", "vacancy", "opening", "title", "list", "item")
SIDE = ", ".join(
    [f"[class*={w}]" for w in "social share follow team testimonial review partner client customer newsletter subscribe contact-form breadcrumb sidebar widget banner popup modal overlay gallery slider carousel swiper copyright legal imprint impressum".split()]
    + [f"[id*={w}]" for w in "social team testimonial newsletter contact-form".split()]
)
MARKERS = ("job", "career", "position", "stelle", "vacancy", "opening", "(m/w/d)", "(m/f/d)", "developer", "engineer", "manager")
BOILERPLATE = ("©", "copyright", "all rights reserved", "privacy policy", "terms of", "cookie", "datenschutz", "impressum", "follow us", "connect with")
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "main", "body", "html", "header", "footer", "nav", "aside", "tr", "br"}


def _drop(root: Node, unless_marked: bool = False) -> Node:
    for x in [x for x in root.walk() if x.tag in DROPPED] + root.select(CONSENT):
        x.drop()
    if unless_marked:
        for x in root.select(SIDE):
            low = x.text(" ").lower()
            if not any(m in low for m in MARKERS):
                x.drop()
        for x in [x for x in root.walk() if x.tag in ("nav", "header", "footer", "aside")]:
            low = x.text(" ").lower()
            n = sum(m in low for m in MARKERS)
            if len(low) > 500 and n < 3 or len(low) > 200 and n < 2 or len(low) <= 200 and n == 0:
                x.drop()
    return root


def _html(x: Node) -> str:
    out, stack = [], list(reversed(x.children))
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            out.append(escape(y, quote=False) if not y.startswith("</") else y)
            continue
        if y.tag.startswith("/"):
            out.append(f"<{y.tag}>")
            continue
        attrs = {k: v for k, v in y.attrs.items() if k in KEPT_ATTRS}
        if "class" in attrs:
            attrs["class"] = " ".join([c for c in attrs["class"].split() if any(w in c.lower() for w in CLASS_WORDS)][:3])
        out.append("<" + " ".join([y.tag, *(f'{k}="{escape(v)}"' for k, v in attrs.items() if v or k != "class")]) + ">")
        if y.tag not in VOID:
            stack.append(Node("/" + y.tag, {}, None))
            stack += reversed(y.children)
    return "".join(out)


def clean(html: str | None) -> str:
    """Without scripts, styles, consent dialogs and idle attributes."""
    out = re.sub(r"\s+", " ", _html(_drop(parse(html))))
    return re.sub(r">\s+<", "><", out).strip()


def markdown(html: str | None) -> str:
    """Headings, lists, links and table rows as Markdown, boilerplate out."""
    out: list[str] = []
    stack: list[tuple[str, Node | str]] = [("node", x) for x in reversed(_drop(parse(html), True).children)]
    while stack:
        kind, x = stack.pop()
        if kind == "text" or isinstance(x, str):
            out.append(x if kind == "text" else re.sub(r"\s+", " ", x))
        elif x.tag == "tr":
            cells = [c.text() for c in x.elements() if c.tag in ("td", "th")]
            out.append("\n" + " | ".join(cells) + "\n" if any(cells) else "")
        else:
            before, after = {"li": ("\n- ", "\n"), "a": ("[", f"]({x.attrs.get('href', '')})"), "b": ("**", "**"), "strong": ("**", "**"), "em": ("*", "*"), "i": ("*", "*")}.get(x.tag, ("", ""))
            if re.fullmatch("h[1-6]", x.tag):
                before, after = "\n" + "#" * int(x.tag[1]) + " ", "\n"
            elif x.tag in _BLOCKS:
                before = after = "\n"
            stack += [("text", after), *[("node", c) for c in reversed(x.children)], ("text", before)]
    lines, last = [], None
    for line in "".join(out).split("\n"):
        line = re.sub(r"\[\s*\]\([^)]*\)", "", re.sub(r"[ \t]+", " ", line))
        low = line.strip().lower()
        if len(low) < 3 or low.startswith(BOILERPLATE) or re.fullmatch(r"[\s\-_=*#|]+", line) or line.strip() == last:
            continue
        lines.append(line)
        last = line.strip()
    return "\n".join(lines).strip()


def without_repeats(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Lines that don't repeat the one before them within their page."""
    w = Window.partitionBy(*by).orderBy(order)
    flagged = lines.withColumn("__same", F.trim(line).eqNullSafe(F.lag(F.trim(line)).over(w)) & (F.row_number().over(w) > 1))
    return flagged.where("not __same").drop("__same")


def markers(c: Column) -> Column:
    """A10: how many of the words that speak of jobs a text holds."""
    low = F.lower(c)
    return F.size(F.filter(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(low, m))).cast("long")


#: Fixed values; a job site's own container comes first.
OWN_SECTIONS = (".o_website_hr_recruitment_jobs_list", ".oe_website_jobs", "[class*=o_website_hr]", "[class*=oe_website_jobs]")
SECTIONS = (
    "[class*=job-list]", "[class*=jobs-list]", "[class*=vacancies]", "[class*=career-list]", "[class*=openings]", "[id*=jobs]", "[id*=vacancies]", "[id*=careers]",
    ".join-jobs-widget", "[class*=join-jobs]", ".personio-jobs", "[class*=personio]", "main", "article", ".content",
)


def job_section(html: str | None) -> str | None:
    """The largest marked part of a page between 300 and 200,000 characters."""
    root = parse(html)
    best = ""
    # A page that names its generator shows its first fitting container
    if any("odoo" in x.attrs.get("content", "").lower() for x in root.select("meta[name=generator]")):
        own = next((p for p in (_html(x) for s in OWN_SECTIONS for x in root.select(s)) if 1000 < len(p) < 200_000), None)
        if own:
            return own
    for s in SECTIONS:
        parts = [p for p in (_html(x) for x in root.select(s) if any(m in x.text(" ").lower() for m in MARKERS)) if 300 < len(p) < 200_000]
        joined = "\n".join(parts)
        if len(joined) > 1000 and len(joined) > len(best):
            best = joined
    return best or None


def _vectorized(f) -> object:
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(f)

    return run


def clean_html(c: Column) -> Column:
    return _vectorized(clean)(c)


def html_to_markdown(c: Column) -> Column:
    return _vectorized(markdown)(c)


def find_job_section(c: Column) -> Column:
    return _vectorized(job_section)(c)

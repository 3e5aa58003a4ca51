"""Aggregates, joins and top-k reports over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: US dollars for a million prompt and completion tokens (fixed values).
PRICES = {
    "openai/gpt-4o-mini": (0.15, 0.60), "openai/gpt-4o": (2.50, 10.00), "openai/gpt-4o-2024-08-06": (2.50, 10.00),
    "anthropic/claude-3.5-sonnet": (3.00, 15.00), "anthropic/claude-3-haiku": (0.25, 1.25), "google/gemini-flash-1.5": (0.075, 0.30),
}
DEFAULT_PRICE = (0.50, 1.50)
USD_PER_SAVED_TOKEN = 0.00001


def dashboard(sites: DataFrame, jobs: DataFrame, career_urls: DataFrame) -> DataFrame:
    """Jobs and career URLs of each site, each side summed before the join."""
    j = jobs.groupBy("site_id").agg(F.count_if("is_active").alias("active_jobs"), F.count("*").alias("total_jobs"))
    u = career_urls.where("is_active").groupBy("site_id").agg(F.count("*").alias("n_urls"))
    out = sites.select(F.col("id").alias("site_id"), "domain", "last_scanned_at").join(j, "site_id", "left").join(u, "site_id", "left").fillna(0, ["active_jobs", "total_jobs", "n_urls"])
    return out.withColumn("removed_jobs", F.col("total_jobs") - F.col("active_jobs"))


def latest_history(history: DataFrame, jobs: DataFrame, sites: DataFrame, n: int, domain: str | None = None) -> DataFrame:
    """J1, T1, SC2: the newest events with their job and site.

    Events without a stored job or site don't count, so the top-n can't be
    taken before the joins; it is one ordered take after them, without a sort
    of everything.
    """
    newest = [F.desc("changed_on"), F.desc("id")]
    if domain is not None:
        sites = sites.where(F.col("domain") == domain)
    j = jobs.select(F.col("id").alias("job_id"), "site_id", "title")
    s = sites.select(F.col("id").alias("site_id"), "domain")
    return history.join(j, "job_id").join(s, "site_id").select("id", "event", "changed_on", "title", "domain").orderBy(*newest).limit(n)


def active_jobs(jobs: DataFrame, site_id: int | None = None) -> DataFrame:
    """SC4: the stored jobs that are active, of one site or of all."""
    rows = jobs.where("is_active")
    return rows if site_id is None else rows.where(F.col("site_id") == site_id)


#: How the history report names its events (fixed values).
ACTIONS = {"added": "добавлена", "removed": "закрыта", "reactivated": "вернулась"}


def history_report(history: DataFrame, jobs: DataFrame, sites: DataFrame, n: int, domain: str | None = None) -> DataFrame:
    """SK5, V30, W6: the newest events as lines of the report.

    history: id, job_id, event, changed_at (text).  ``heading`` is the day
    where it differs from that of the line above; the site is named only where
    the report is not of one site.
    """
    s = sites if domain is None else sites.where(F.col("domain") == domain)
    rows = history.join(jobs.select(F.col("id").alias("job_id"), "site_id", "title", "location"), "job_id").join(s.select(F.col("id").alias("site_id"), "domain"), "site_id")
    newest = rows.orderBy(F.desc("changed_at"), F.desc("id")).limit(n)  # the limit bounds what the window below sees
    day = text.report_day(F.col("changed_at"))
    order = Window.orderBy(F.desc("changed_at"), F.desc("id"))
    lines = newest.withColumns({"line": F.row_number().over(order), "day": day, "above": F.lag(day).over(order)})
    where = F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit(" ("), "location", F.lit(")"))).otherwise("")
    site = F.lit("") if domain is not None else F.concat(F.lit(" ["), "domain", F.lit("]"))
    action = F.coalesce(*[F.when(F.col("event") == e, F.lit(a)) for e, a in ACTIONS.items()], F.col("event"))
    said = F.concat(F.col("title"), where, site, F.lit(" — "), action)
    return lines.select("line", F.when(~F.col("day").eqNullSafe(F.col("above")), F.col("day")).alias("heading"), text.report_clock(F.col("changed_at")).alias("clock"), said.alias("said"))


def search_parameters(place: Column, suggested: Column, years: Column, salary: Column) -> list[Column]:
    """parameters of a job-site search; an unknown place is the site's first
    suggestion, a wanted salary leaves out postings without one."""
    return [
        text.lookup(F.lower(place), text.AREAS, suggested).alias("area"), text.lookup(years, text.EXPERIENCE, F.lit(None).cast("string")).alias("experience"),
        salary.alias("salary"), F.when(salary.isNotNull(), True).alias("only_with_salary"),
    ]


def cost_usd(model: Column, prompt: Column, completion: Column, reported: Column) -> Column:
    """Estimated from the price table where none is reported."""
    a, b = F.lit(DEFAULT_PRICE[0]), F.lit(DEFAULT_PRICE[1])
    for m, (x, y) in PRICES.items():
        a, b = F.when(model == m, x).otherwise(a), F.when(model == m, y).otherwise(b)
    return F.when(reported > 0, reported).otherwise(prompt / 1e6 * a + completion / 1e6 * b)


def usage(calls: DataFrame) -> DataFrame:
    """Totals of each model."""
    cost = cost_usd(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), F.col("reported_usd"))
    seconds = [F.round(F.sum("seconds"), 4).alias("seconds")] if "seconds" in calls.columns else []
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum(cost), 4).alias("usd"), *seconds
    )


def tracked(responses: DataFrame) -> DataFrame:
    """P10: calls (model, tokens, reported cost) from answers (model, body, seconds)
    of either kind of provider; the local one has other field names and no cost."""
    got = F.from_json("body", "struct<usage: struct<prompt_tokens: bigint, completion_tokens: bigint, cost: double>, prompt_eval_count: bigint, eval_count: bigint>")
    v = responses.withColumn("__v", got)
    zero = lambda *c: F.coalesce(*c, F.lit(0))
    return v.select(
        "model", "seconds", zero("__v.usage.prompt_tokens", "__v.prompt_eval_count").alias("prompt_tokens"),
        zero("__v.usage.completion_tokens", "__v.eval_count").alias("completion_tokens"), F.coalesce("__v.usage.cost", F.lit(0.0)).alias("reported_usd"),
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    """A4, A5: entries, hits and tokens saved of each namespace."""
    out = cache.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum("hit_count").alias("hits"), F.sum(F.col("tokens_saved") * F.col("hit_count")).alias("tokens_saved"))
    return out.select("*", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("entries")), F.lit(0.0)), 6).alias("hit_rate"), F.round(F.col("tokens_saved") * USD_PER_SAVED_TOKEN, 6).alias("saved_usd"))


def best_careers_url(urls_: DataFrame, rank: Column) -> DataFrame:
    """T4: the URL with the least key of each site; ties go to the first."""
    return urls_.groupBy("site_id").agg(F.min_by("url", F.struct(rank.alias("rank"), F.col("id").alias("id"))).alias("best_url"))


#: What error texts say (fixed values).
UNREACHABLE = [
    "name or service not known", "nodename nor servname provided", "getaddrinfo failed", "no address associated", "name resolution failed",
    "temporary failure in name resolution", "connection refused", "[errno 111]", "[winerror 10061]",
    "err_name_not_resolved", "err_connection_refused", "err_connection_reset", "err_connection_timed_out", "err_network_changed", "err_internet_disconnected", "err_address_unreachable",
]
CERTIFICATE = [
    "certificate verify failed", "ssl: certificate_verify_failed", "certificate_verify_failed", "unable to get local issuer certificate", "self signed certificate", "ssl handshake", "[ssl:",
]


def failure(error: Column) -> Column:
    """what an error without a status is: no such host, a bad certificate
    (tried again without its check), or another."""
    low = F.lower(error)
    return F.when(error.isNull(), None).when(text.contains_any(low, UNREACHABLE), "unreachable").when(text.contains_any(low, CERTIFICATE), "certificate").otherwise("error")


def outcome(status: Column) -> Column:
    """what a fetch came to."""
    return (
        F.when(status.isin(429, 503), "limited").when(status == 403, "challenge").when(status.between(520, 526), "challenge")
        .when(status.between(200, 399), "ok").when(status.between(400, 499), "client_error").otherwise("server_error")
    )


def terminal_rows(jobs: DataFrame) -> DataFrame:
    """SK3: the six columns of the terminal's table."""
    pay = text.salary_display(F.col("salary_from"), F.col("salary_to"), F.col("salary_currency"))
    return jobs.select("company", "title", F.coalesce("title_en", F.lit("—")).alias("title_en"), "location", pay.alias("salary"), "source")


def elapsed(seconds: Column) -> Column:
    """SK4: seconds, minutes and seconds, or hours, minutes and seconds."""
    hours, minutes = F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int")
    return (
        F.when(seconds < 60, F.format_string("%.2f сек", seconds))
        .when(seconds < 3600, F.format_string("%d мин %.1f сек", minutes, seconds % 60))
        .otherwise(F.format_string("%d ч %d мин %.0f сек", hours, minutes, seconds % 60))
    )

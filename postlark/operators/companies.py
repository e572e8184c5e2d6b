"""The watch list: companies from a sheet, and which board each address stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import collapsed, source_url
from ..functions.vocabulary import BOARD_HOSTS

# First cells of rows that are headings.
HEADINGS = ("company", "companies", "company name", "name", "חברה", "שם החברה")


def company_rows(raw: DataFrame) -> DataFrame:
    """ordinal, name, url of a two-column export without headings and blank rows."""
    r = raw.select("ordinal", F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.trim(F.coalesce("url", F.lit(""))).alias("url"))
    return r.where(((F.col("name") != "") | (F.col("url") != "")) & ~F.lower("name").isin(*HEADINGS)).withColumn("url", F.nullif(F.col("url"), F.lit("")))


def sync_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """normalized_name, name, url, enabled and action (created, updated, unchanged, disabled, absent) of every company on either side.

    Of rows with one name the last counts. A company that comes back is enabled again.
    """
    last = Window.partitionBy("key").orderBy(F.desc("ordinal"))
    new = rows.where(F.col("name") != "").withColumn("key", collapsed(F.col("name"))).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    new = new.select("key", F.col("name").alias("new_name"), F.col("url").alias("new_url"), F.lit(True).alias("__new"))
    old = companies.select(F.col("normalized_name").alias("old_key"), F.col("name").alias("old_name"), F.col("original_sheet_url").alias("old_url"), F.col("enabled").alias("was"), F.lit(True).alias("__old"))
    both = new.join(old, F.col("key") == F.col("old_key"), "full")
    differs = ~F.col("new_name").eqNullSafe(F.col("old_name")) | ~F.col("new_url").eqNullSafe(F.col("old_url")) | ~F.col("was")
    action = (
        F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull() & F.col("was"), "disabled").when(F.col("__new").isNull(), "absent")
        .when(differs, "updated").otherwise("unchanged")
    )
    there = F.col("__new").isNotNull()
    return both.select(
        F.coalesce("key", "old_key").alias("normalized_name"), F.when(there, F.col("new_name")).otherwise(F.col("old_name")).alias("name"),
        F.when(there, F.col("new_url")).otherwise(F.col("old_url")).alias("url"), there.alias("enabled"), action.alias("action"),
    )


def sync_counters(synced: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """matched: resolved addresses as match_source returns them; those without a stored source are new ones."""
    counts = synced.agg(
        F.count_if("enabled").alias("companies_seen"), F.count_if(F.col("action") == "created").alias("companies_created"),
        F.count_if(F.col("action") == "updated").alias("companies_updated"), F.count_if(F.col("action") == "disabled").alias("companies_disabled"),
    )
    return counts if matched is None else counts.crossJoin(matched.agg(F.count_if(F.col("source_id").isNull()).alias("sources_created")))  # one row each


def retire_missing(synced: DataFrame, companies: DataFrame, sources: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The enabled sources of companies that left the sheet disabled, and their open postings closed."""
    gone = companies.join(synced.where("action = 'disabled'").select("normalized_name"), "normalized_name", "left_semi").select(F.col("id").alias("company_id"))
    return retire_sources(sources, postings, sources.where("enabled").join(gone, "company_id", "left_semi").select(F.col("id").alias("source_id")))


def read_company_rows(spark: SparkSession, path: str) -> DataFrame:
    """company_rows of a CSV export; files and the lines in them keep their order."""
    raw = spark.read.csv(path, schema="name string, url string", header=False, multiLine=True)
    return company_rows(raw.withColumn("ordinal", F.monotonically_increasing_id()))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(source_url(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def classify_source(url: Column, hosts: list[tuple[str, str]] = BOARD_HOSTS) -> Column:
    """The type of board behind an address, by its host or a parent of it; generic_html for other sites, unsupported for none."""
    host = host_of(url)
    out = F.when(url.isNull() | (F.trim(url) == "") | (host == ""), "unsupported")
    for end, kind in [("linkedin.com", "unsupported"), *hosts, *((h, "site_feed") for h in FEED_HOSTS)]:
        out = out.when((host == end) | host.endswith(f".{end}"), kind)
    return out.otherwise("generic_html")


def source_identifier(url: Column, kind: Column) -> Column:
    """The board's own name in its address."""
    path = F.filter(F.split(F.regexp_replace(F.regexp_extract(source_url(url), r"^[^:]+://[^/?#]+([^?#]*)", 1), "^/", ""), "/"), lambda p: p != "")
    query = F.regexp_extract(url, r"[?&]for=([^&#]+)", 1)
    host = host_of(url)
    first, third = F.try_element_at(path, F.lit(1)), F.try_element_at(path, F.lit(3))
    feed = None
    for name, label in FEED_HOSTS.items():
        hit = (host == name) | host.endswith(f".{name}")
        feed = F.when(hit, label) if feed is None else feed.when(hit, label)
    return (
        F.when(kind == "greenhouse", F.when(first == "embed", F.nullif(query, F.lit(""))).otherwise(first))
        .when(kind == "workday", workday_board(host, path))
        .when(kind == "taleo", F.split(host, r"\.")[0])
        .when(kind == "comeet", F.when((F.size(path) >= 3) & (first == "jobs"), third).when(F.size(path) > 0, F.try_element_at(path, F.lit(-1))))
        .when(kind.isin("lever", "ashby", "smartrecruiters", "workable"), first)
        .when(kind == "site_feed", feed)
    )


def workday_board(host: Column, path: Column) -> Column:
    """tenant/site; locales and parts of deep links are no sites, and without a site there is no board."""
    site = F.get(F.filter(path, lambda p: ~p.rlike(r"^[a-z]{2}(?:-[A-Za-z]{2,4})?$") & ~F.lower(p).isin(*_NOT_WORKDAY_SITES)), F.lit(0))
    return F.concat(F.split(F.lower(host), r"\.")[0], F.lit("/"), site)


# How pages refer to a hosted board, the most telling first.
_SLUG, _UID, _STOP = r"[A-Za-z0-9_.-]+", r"[A-Z0-9]{2}\.[A-Z0-9]{3}", r"(?=[/\"'?\s]|$)"
BOARD_LINKS = [
    ("comeet", rf"https?://(?:www\.)?comeet\.com/jobs/{_SLUG}/({_UID})(?![A-Za-z0-9])"),
    ("comeet", rf"[\"']company-uid[\"']\s*:\s*[\"']({_UID})[\"']"),
    ("comeet", rf"(?i)comeet\.co/careers-api/[\d.]+/company/({_UID})/positions"),
    ("greenhouse", rf"boards\.greenhouse\.io/embed/job_board(?:/js)?\?(?:[^\"'\s]*?&)?for=({_SLUG})"),
    ("greenhouse", rf"(?:job-boards\.greenhouse\.io|boards\.greenhouse\.io|boards-api\.greenhouse\.io/v1/boards)/({_SLUG})(?=[/\"'?\s])"),
    ("lever", rf"jobs(?:\.eu)?\.lever\.co/({_SLUG}){_STOP}"),
    ("ashby", rf"(?:jobs\.ashbyhq\.com|api\.ashbyhq\.com/posting-api/job-board)/({_SLUG}){_STOP}"),
    ("workable", rf"apply\.workable\.com/(?:api/v\d+/widget/accounts/)?({_SLUG}){_STOP}"),
    ("workday", r"(?i)((?:https?:)?//[a-z0-9-]+\.wd\d+\.myworkdayjobs\.com(?:/[^\s\"'<>?#]*)?)"),
    ("smartrecruiters", rf"(?:(?:jobs|careers)\.smartrecruiters\.com|api\.smartrecruiters\.com/v1/companies)/({_SLUG}){_STOP}"),
]
# The other host of one type; marks of a plugin, of its postings' addresses and of ids on these; hints of a type.
LEVER_EU = "jobs.eu.lever.co"
_PLUGIN = r"(?i)comeet\.co/careers-api/api\.js|comeet-outer-wrapper|comeet_style-css|comeet-groups-list"
_POSITION = rf"href=[\"']([^\"'\s]*/{_UID}/?[^\"'\s]*)[\"']"
_ANY_UID, _API_UID = rf"company[-_]uid[\"']?\s*[:=]\s*[\"']({_UID})[\"']", rf"careers-api/2\.0/company/({_UID})"
BOARD_HINTS = [("greenhouse", r"(?i)greenhouse|[?&]gh_(?:department|jid|src)="), ("lever", r"(?i)lever\.co|\blever\b"), ("ashby", r"(?i)ashby")]
# Parts of addresses that are no board's name, and hosts with a feed of their own.
_NOT_SLUGS = ("embed", "api", "j", "static", "assets", "css", "js", "widget")
_NOT_WORKDAY_SITES = ("wday", "job", "login", "page", "en", "he")
FEED_HOSTS = {"elbitsystemscareer.com": "elbit", "jobs.iai.co.il": "iai", "amazon.jobs": "amazon"}
# Marks of a site's own content system, and names of post types that hold jobs.
_WORDPRESS = r"(?i)/wp-content/|/wp-json/"
_JOB_TYPES = r"(?i)job|position|career|vacan|opening|drushim|misra"


def detect_boards(pages: DataFrame, body: str = "html", key: str = "page_id") -> DataFrame:
    """key, board_type, identifier, rank, host of every board that a page names, the most telling first. host: where it is not the type's usual one."""
    text = F.replace(F.col(body), F.lit("\\/"), F.lit("/"))
    hits = F.flatten(F.array(*(_hits(text, p, k, r) for r, (k, p) in enumerate(BOARD_LINKS))))
    rows = pages.select(key, F.posexplode(hits).alias("at", "hit")).select(key, "at", "hit.*").where(F.col("identifier").isNotNull() & ~F.lower("identifier").isin(*_NOT_SLUGS))
    best = Window.partitionBy(key).orderBy("order", "at")
    first = rows.groupBy(key, "board_type", "identifier").agg(F.min(F.struct("order", "at", "host")).alias("first"))
    return first.select(key, "board_type", "identifier", "first.*").withColumn("rank", F.row_number().over(best)).select(key, "board_type", "identifier", "rank", "host")


def _hits(text: Column, pattern: str, kind: str, order: int) -> Column:
    def identifier(m: Column) -> Column:
        if kind == "workday":
            bare = F.regexp_replace(m, "^(?:https?:)?//", "")
            return workday_board(F.split(bare, "/")[0], F.filter(F.slice(F.split(bare, "/"), 2, 1_000_000), lambda p: p != ""))
        return F.upper(m) if kind == "comeet" else m

    def hit(m: Column, host: Column) -> Column:
        return F.struct(F.lit(kind).alias("board_type"), identifier(m).alias("identifier"), F.lit(order).alias("order"), host.alias("host"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    if kind != "lever":
        return F.transform(found, lambda m: hit(m, F.lit(None).cast("string")))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(found, whole, lambda m, w: hit(m, F.when(w.startswith(LEVER_EU), F.lit(LEVER_EU))))


def board_url(kind: Column, identifier: Column, host: Column) -> Column:
    """Where a board of the types that are asked by name is listed; on its own host where detect_boards found one."""
    return (
        F.when(kind == "greenhouse", F.concat(F.lit("https://job-boards.greenhouse.io/"), identifier))
        .when(kind == "lever", F.concat(F.lit("https://"), F.coalesce(host, F.lit("jobs.lever.co")), F.lit("/"), identifier))
        .when(kind == "ashby", F.concat(F.lit("https://jobs.ashbyhq.com/"), identifier))
    )


def board_probes(pages: DataFrame, body: str = "html", key: str = "page_id") -> DataFrame:
    """key, board_type, url, rank: what to fetch for pages that name no board but show that one is in play.

    A page of a board's plugin links to postings of its own, on which the board's id stands; a hint of a type stands for a
    board named as the company's domain, to be kept if it answers. Fetching is for others; ``probed`` reads what they land.
    """
    bare = pages.join(detect_boards(pages, body, key).select(key), key, "left_anti")
    plugin = F.col(body).rlike(_PLUGIN)
    links = F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(_POSITION), F.lit(1))), lambda h: F.struct(F.lit("comeet").alias("board_type"), h.alias("url")))
    label = T.domain_label(host_of(F.col("url")))
    hints = [F.when(F.col(body).rlike(p), F.struct(F.lit(k).alias("board_type"), board_url(F.lit(k), label, F.lit(None)).alias("url"))) for k, p in BOARD_HINTS]
    every = F.concat(F.when(plugin, links).otherwise(F.array().cast("array<struct<board_type:string,url:string>>")), F.array_compact(F.array(*hints)))
    rows = bare.select(key, F.col("url").alias("__base"), F.posexplode(every).alias("at", "x"))
    return rows.select(key, "x.board_type", F.when(F.col("x.url").rlike("^https?://"), F.col("x.url")).otherwise(F.concat(F.regexp_extract("__base", "^[a-zA-Z]+://[^/?#]+", 0), F.regexp_replace("x.url", "^/?", "/"))).alias("url"), (F.col("at") + 1).alias("rank"))


def probed(answers: DataFrame, key: str = "page_id") -> DataFrame:
    """key, board_type, identifier of the first probe that found a board. answers: board_probes' columns, and body (null: none came)."""
    uid = F.upper(F.coalesce(F.nullif(F.regexp_extract("body", _ANY_UID, 1), F.lit("")), F.nullif(F.regexp_extract("body", _API_UID, 1), F.lit(""))))
    name = F.when(F.col("board_type") == "comeet", uid).otherwise(F.regexp_extract("url", "([^/]+)$", 1))
    good = answers.where("body is not null").withColumn("identifier", name).where("identifier is not null")
    best = Window.partitionBy(key).orderBy("rank")
    return good.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(key, "board_type", "identifier")


def wordpress_job_types(pages: DataFrame, types: DataFrame, totals: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, rest_base of the first post type, in the order of the site's index, that holds more jobs than the page links to.

    pages: page_id, html; types: page_id, body (the index of types as JSON); totals: page_id, rest_base, total;
    listed: page_id, links (as job_links counts them).
    """
    marked = pages.where(F.col("html").rlike(_WORDPRESS)).select("page_id")
    names = F.json_object_keys("body")
    infos = F.from_json("body", "map<string,struct<rest_base:string>>")
    rows = types.join(marked, "page_id", "left_semi").select("page_id", infos.alias("infos"), F.posexplode(names).alias("at", "slug"))
    rows = rows.withColumn("rest_base", F.coalesce(F.nullif(F.try_element_at("infos", F.col("slug"))["rest_base"], F.lit("")), F.col("slug")))
    jobs = rows.where(F.concat_ws(" ", "slug", "rest_base").rlike(_JOB_TYPES)).join(totals, ["page_id", "rest_base"]).join(listed.select("page_id", "links"), "page_id", "left")
    more = jobs.where(F.col("total") > F.coalesce("links", F.lit(0)))
    return more.groupBy("page_id").agg(F.min_by("rest_base", "at").alias("rest_base"))


def match_source(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """The stored source that a resolved board is: by type and identifier, else for plain pages the company's enabled board, else by address.

    resolved: company_id, url (what is crawled), board_type, identifier and, where a page led to it, page_url.
    Adds source_id (null: a new one) and rule.
    """
    page = F.col("page_url") if "page_url" in resolved.columns else F.lit(None).cast("string")
    s = sources.select(F.col("id").alias("source_id"), F.col("company_id").alias("__company"), F.col("source_type").alias("__type"), F.col("external_identifier").alias("__ident"), F.col("source_url").alias("__url"), F.col("enabled").alias("__enabled"))
    both = resolved.join(s, F.col("company_id") == F.col("__company"), "left")
    rule = (
        F.when(F.col("__type").eqNullSafe(F.col("board_type")) & F.col("identifier").isNotNull() & (F.col("__ident") == F.col("identifier")), 1)
        .when((F.col("board_type") == "generic_html") & F.col("__enabled") & ~F.col("__type").isin("generic_html", "playwright", "unsupported"), 2)
        .when((F.col("__url") == F.col("url")) | (F.col("__url") == page), 3)
    )
    best = Window.partitionBy("company_id", "url").orderBy(F.asc_nulls_last("rule"), "source_id")
    ranked = both.withColumn("rule", rule).withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return ranked.select(*resolved.columns, F.when(F.col("rule").isNotNull(), F.col("source_id")).alias("source_id"), "rule")


def reconcile_sources(sources: DataFrame, resolved: DataFrame, default: int = 5) -> DataFrame:
    """sources after their addresses were resolved anew. resolved: source_id, board_type, identifier and, where it changed, url.

    A plain page, which is also what a failed probe gives, changes nothing but for unsupported sources; an unknown
    identifier does not replace a known one. A source that is supported and was disabled comes back and is due.
    """
    from .crawl import poll_minutes

    url = F.col("url") if "url" in resolved.columns else F.lit(None).cast("string")
    r = resolved.select(F.col("source_id").alias("__id"), F.col("board_type").alias("__type"), F.col("identifier").alias("__ident"), url.alias("__url"))
    s = sources.join(r, sources["id"] == F.col("__id"), "left")
    taken = F.col("__id").isNotNull() & ~((F.col("__type") == "generic_html") & (F.col("source_type") != "unsupported"))
    moved = taken & (~F.col("source_type").eqNullSafe(F.col("__type")) | F.col("__ident").isNotNull() & ~F.col("external_identifier").eqNullSafe(F.col("__ident")))
    back = taken & (F.when(moved, F.col("__type")).otherwise(F.col("source_type")) != "unsupported") & ~F.col("enabled")
    new = {
        "source_type": F.when(moved, F.col("__type")), "external_identifier": F.when(moved, F.col("__ident")), "poll_interval_minutes": F.when(moved, poll_minutes(F.col("__type"), default)),
        "consecutive_failures": F.when(moved, F.lit(0)),
    }
    out = []
    for c in sources.columns:
        if c == "next_check_at":
            out.append(F.when(~(moved | back), F.col(c)).alias(c))
        elif c == "enabled":
            out.append((F.col(c) | back).alias(c))
        elif c == "source_url":
            out.append(F.when(taken, F.coalesce("__url", c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c))
    return s.select(*out)


def retire_sources(sources: DataFrame, postings: DataFrame, retired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources of retired (source_id) disabled, and their open postings closed."""
    r = retired.select(F.col("source_id").alias("__id")).distinct()
    s = sources.join(r, sources["id"] == F.col("__id"), "left").withColumn("enabled", F.col("enabled") & F.col("__id").isNull()).select(*sources.columns)
    p = postings.join(r, postings["career_source_id"] == F.col("__id"), "left")
    p = p.withColumn("status", F.when(F.col("__id").isNotNull() & (F.col("status") == "active"), "closed").otherwise(F.col("status"))).select(*postings.columns)
    return s, p


def retire_others(sources: DataFrame, postings: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each company in current (company_id, source_id) every other enabled source retired."""
    c = current.select("company_id", F.col("source_id").alias("__current"))
    others = sources.where("enabled").join(c, "company_id").where(F.col("id") != F.col("__current"))
    return retire_sources(sources, postings, others.select(F.col("id").alias("source_id")))

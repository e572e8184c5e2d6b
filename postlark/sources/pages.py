"""Plain career pages: links, which group of them lists jobs, titles and text; and lists of jobs in JSON that a page loaded.

Pages come as rows of elements and text pieces; all that is read from them is columns and aggregates over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from ..operators.companies import host_of
from . import boards
from .elements import around, dealt, kept_pieces, part_count, pieces, said, squeezed, tag_of

# Titles that are no posting's, and words of a page of search results.
GENERIC = (
    "משרות", "משרה", "דרושים", "קריירה", "חיפוש משרה", "jobs", "job", "careers", "career", "open positions", "positions", "vacancies", "opportunities", "join us",
    "join our team", "work with us", "job details", "job description",
)
NAVIGATION = (
    r"(?iU)^(?:home|careers?|jobs|about(?: us)?|contact(?: us)?|apply(?: now)?|read more|learn more|more|all jobs|open positions|view all|see all|back|next|previous|prev|login|sign in"
    r"|share|privacy|terms|search|filter|menu|close|\d+|»|«|>|<)$"
)
RESULTS = (
    r"(?iU)מצאנו\s+(?:עבורך|לך|עבורכם)?\s*\d+\s+משרות|נמצאו\s+\d+\s+משרות|\d+\s+משרות\s+נמצאו"
    r"|showing\s+\d+\s+(?:of\s+\d+\s+)?(?:jobs|results|positions)|\d+\s+(?:jobs|results|positions)\s+found"
)
# What links and titles of postings look like, what says nothing, and what is no part of a posting's text.
TITLE_CLASS = r"(?iU)\..*(?:title|position-name|job-name|role)"
JOB_PATH = r"(?iU)job|career|position|vacanc|opening|opportunit|role|משרה|משרות|דרושים|קריירה"
CALLS = (
    r"(?iU)^(?:view(?: details?| job| position| more)?|read more|learn more|more info(?:rmation)?|details|apply(?: now| here)?|see (?:more|details|job)|open|go"
    r"|לפרטים(?: נוספים)?|למשרה(?: המלאה)?|הגש(?:/י)? מועמדות|קרא(?:/י)? עוד|עוד|פרטים(?: נוספים)?)$"
)
APPLY = r"(?iU)apply|submit|הגש|הגישו|מועמדות|שלח(?:ו|/י)? קורות"
SKIPPED = r"(?i)^(?:mailto:|tel:|javascript:|#)"
FILES = r"(?i)\.(?:pdf|png|jpg|jpeg|gif|svg|zip|doc|docx)$"
CHROME = ("script", "style", "nav", "header", "footer", "aside", "noscript", "form")
LISTS = ("ul", "ol", "aside", "nav", "section", "div")
MOST_TITLE, MOST_PLACE, LEAST_BODY, CARD = 120, 60, 400, 4
_HEADING = r"^h[1-6]\."


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, page_url, ordinal, href, url, title and shape of each link with an address. Links of one list have one shape: the link and two elements around it.

    A link's title is the first heading in it, or what its class calls a title; else its text, else its label. One that only
    calls to act takes the first such name in the nearest of CARD elements around it. url is null for other schemes and files.
    """
    rows = pieces(pages)
    href = F.trim(F.element_at("attributes", "href"))
    link = (F.col("tag") == "a") & (href != "")
    named = lambda e: e["mark"].rlike(_HEADING) | e["mark"].rlike(TITLE_CLASS)
    # Of each link and each named element its texts, and what its own row says.
    own = F.struct("url", href.alias("href"), "attributes", "path", "marks")
    mine = F.when(F.col("tag").isNotNull(), F.filter(F.array(F.struct(F.col("at").alias("node"), F.element_at("marks", -1).alias("mark"))), lambda e: named(e) | (tag_of(e["mark"]) == "a")))
    text_of = F.transform(around(lambda e: named(e) | (tag_of(e["mark"]) == "a")), lambda e: F.struct(e["node"].alias("node"), e["mark"].alias("mark")))
    facts = rows.select("page_id", "at", "text", F.when(F.col("tag").isNotNull(), own).alias("own"), link.alias("link"), F.explode(F.coalesce(mine, text_of)).alias("of"))
    things = facts.groupBy("page_id", F.col("of.node").alias("node")).agg(
        F.first("of.mark").alias("mark"), F.first(F.when(F.col("of.node") == F.col("at"), F.col("own")), True).alias("own"), F.bool_or(F.coalesce("link", F.lit(False))).alias("link"), said(F.col("at"), F.coalesce("text", F.lit(""))).alias("said")
    )
    # To each element what is named inside it, and who asks for that: a link for itself and for the elements around it.
    depth = F.size("own.path")
    inner = F.when(named({"mark": F.col("mark")}) & (F.col("said") != ""), F.transform(F.slice("own.path", F.lit(1), depth - 1), lambda n: F.struct(n.alias("at"), F.struct((~F.col("mark").rlike(_HEADING)).alias("later"), F.col("node").alias("node"), F.col("said").alias("name")).alias("name"), F.lit(None).cast("int").alias("ask"), F.lit(None).cast("int").alias("far"))))
    near = F.reverse(F.slice("own.path", F.greatest(F.lit(1), depth - CARD), F.least(depth, F.lit(CARD + 1))))
    asks = F.when(F.col("link"), F.transform(near, lambda n, k: F.struct(n.alias("at"), F.lit(None).cast("struct<later:boolean,node:int,name:string>").alias("name"), F.col("node").alias("ask"), k.alias("far"))))
    own_row = F.when(F.col("link"), F.struct("node", "own", "said"))
    sent = things.select("page_id", own_row.alias("self"), F.explode(F.concat(F.coalesce(inner, F.array().cast(_SENT)), F.coalesce(asks, F.array().cast(_SENT)))).alias("x"))
    met = sent.groupBy("page_id", F.col("x.at").alias("node")).agg(F.min("x.name").alias("name"), F.collect_list(F.when(F.col("x.ask").isNotNull(), F.struct(F.col("x.ask").alias("ask"), F.col("x.far").alias("far"), F.when(F.col("x.far") == 0, F.col("self")).alias("self")))).alias("asked"))
    told = met.select("page_id", F.col("name.name").alias("name"), F.inline("asked"))
    got = told.groupBy("page_id", F.col("ask").alias("node")).agg(
        F.first("self", True).alias("self"), F.max(F.when(F.col("far") == 0, F.col("name"))).alias("inside"), F.min_by("name", F.when(F.col("name").isNotNull() & (F.col("far") > 0), F.col("far"))).alias("card")
    )
    label = F.array(*(squeezed(F.element_at("self.own.attributes", k)) for k in ("aria-label", "title")))
    title = F.coalesce("inside", F.nullif(F.col("self.said"), F.lit("")), F.get(F.filter(label, lambda x: x != ""), F.lit(0)), F.lit(""))
    title = F.when(title.rlike(CALLS), F.coalesce("card", F.lit(""))).otherwise(title)
    shape = F.transform(F.reverse(F.slice("self.own.marks", F.greatest(F.lit(1), F.size("self.own.marks") - 2), F.lit(3))), lambda m: F.substring_index(m, " ", 1))
    href, url = F.col("self.own.href"), F.col("self.own.url")
    target = absolute(url, href)
    order = Window.partitionBy("page_id").orderBy("node")
    return got.select(
        "page_id", url.alias("page_url"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"), href.alias("href"),
        F.when(~href.rlike(SKIPPED) & target.rlike("^https?://") & ~_path(target).rlike(FILES), target).alias("url"), title.alias("title"), F.array_join(shape, ">").alias("shape"),
    )


_SENT = "array<struct<at:int,name:struct<later:boolean,node:int,name:string>,ask:int,far:int>>"


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def job_links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, ordinal, url, title of the links that list a page's jobs.

    The group of links of one shape with the most that look like jobs, and strays whose title and path both do;
    each address once, in page order; of a page the first ``most``, or all.
    """
    said = F.length("title").between(3, MOST_TITLE) & ~F.col("title").rlike(NAVIGATION) & F.col("title").rlike("[A-Za-z\u0590-\u05ff]")
    links = page_links(pages).where(F.col("url").isNotNull() & said)
    links = links.where((T.registrable_host(host_of(F.col("url"))) == T.registrable_host(host_of(F.col("page_url")))) & (F.col("url") != F.regexp_replace("page_url", "#.*$", "")))
    named, path = F.col("title").rlike(T.ROLE_WORDS), _path(F.col("url")).rlike(JOB_PATH)
    links = links.withColumns({"named": named, "jobish": named | path, "both": named & path})
    groups = links.groupBy("page_id", "shape").agg(F.count("*").alias("n"), F.count_if("jobish").alias("jobs"), F.min("ordinal").alias("first"))
    best = Window.partitionBy("page_id").orderBy(F.desc("jobs"), "first")
    chosen = groups.where((F.col("n") >= 3) & (F.col("jobs") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2)))).withColumn("__n", F.row_number().over(best)).where("__n = 1").select("page_id", "shape")
    members = links.join(chosen, ["page_id", "shape"], "left_semi")
    once, order = Window.partitionBy("page_id", "url").orderBy("ordinal"), Window.partitionBy("page_id").orderBy("ordinal")
    both = members.unionByName(links.where("both")).select("page_id", "ordinal", "url", "title")
    first = both.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return first if most is None else first.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def link_groups(pages: DataFrame) -> DataFrame:
    """How many links of each shape a page has, and how many of them look like jobs."""
    jobish = F.col("title").rlike(T.ROLE_WORDS) | F.coalesce(_path(F.col("url")).rlike(JOB_PATH), F.lit(False))
    return page_links(pages).groupBy("page_id", "shape").agg(F.count("*").alias("links"), F.count_if(jobish).alias("jobs"))


def generic_title(x: Column) -> Column:
    """Whether a title is none, or a section's name."""
    return F.coalesce((F.trim(x) == "") | F.lower(F.trim(x)).isin(*GENERIC), F.lit(True))


def _first_good(*options: Column) -> Column:
    return F.get(F.filter(F.array(*options), lambda t: ~generic_title(t) & (F.length(t) <= MOST_TITLE)), F.lit(0))


def _lines(text: Column, most: int | None) -> Column:
    lines = F.split(text, "\n")
    return F.transform(lines if most is None else F.slice(lines, 1, most), lambda t: F.trim(t))


def first_title_like_line(text: Column, most: int | None = None) -> Column:
    """The first line that says something, of the first ``most`` or of all."""
    return F.get(F.filter(_lines(text, most), lambda t: ~generic_title(t) & (F.length(t) <= MOST_TITLE)), F.lit(0))


def guess_location(text: Column, most: int | None = None) -> Column:
    """The first short line that names a known place, of the first ``most`` or of all."""
    short = F.filter(_lines(text, most), lambda t: (t != "") & (F.length(t) <= MOST_PLACE))
    return F.get(F.filter(short, lambda t: (classify.country(t) == "Israel") | classify.clearly_abroad(t)), F.lit(0))


def page_heads(pages: DataFrame) -> DataFrame:
    """page_id, url and what stands at the top of a page: h1, headings (four of h2 and h3), og, head (the title up to a bar or dash); whole, its text; form and apply, whether it can be answered."""
    heads = ("h1", "h2", "h3", "title", "a", "button")
    parts = part_count(pages)
    rows = pieces(pages.select("page_id", "url", "html"), parts)
    inside = around(lambda e: tag_of(e["mark"]).isin(*heads))
    # A text goes to each of these around it, an element to itself; all go to the page, under 0.
    to = F.concat(F.array(F.struct(F.lit(0).alias("node"), F.lit("page.").alias("mark"))), F.transform(inside, lambda e: F.struct(e["node"].alias("node"), e["mark"].alias("mark"))))
    attribute = lambda name: F.element_at("attributes", name)
    facts = rows.select("page_id", "url", "at", "text", "tag", F.explode(to).alias("of"), F.when((F.col("tag") == "meta") & (attribute("property") == "og:title"), F.trim(attribute("content"))).alias("og"), F.when(F.col("tag") == "a", attribute("href")).alias("href"))
    things = facts.groupBy("page_id", "of.node", tag_of(F.col("of.mark")).alias("tag")).agg(
        F.first("url").alias("url"), said(F.col("at"), F.coalesce("text", F.lit(""))).alias("said"), F.min_by("og", F.when(F.col("og").isNotNull(), F.col("at"))).alias("og"), F.max("href").alias("href"), F.bool_or(F.col("tag") == "form").alias("form")
    )
    when = lambda tag, value: F.when(F.col("tag").isin(*tag) if isinstance(tag, tuple) else F.col("tag") == tag, value)
    first = lambda tag: F.min(when(tag, F.struct("node", "said")))["said"]
    answers = F.col("said").rlike(APPLY) | F.coalesce(F.col("href").rlike(APPLY), F.lit(False))
    some = F.transform(F.slice(F.array_sort(F.collect_list(when(("h2", "h3"), F.struct("node", "said")))), 1, 4), lambda x: x["said"])
    got = things.groupBy("page_id").agg(
        F.first("url").alias("url"), first("h1").alias("h1"), some.alias("headings"), F.max(when("page", F.col("og"))).alias("og"), F.trim(F.regexp_replace(first("title"), r"\s*(?:\|| - ).*$", "")).alias("head"),
        F.coalesce(F.bool_or(when("page", F.col("form"))), F.lit(False)).alias("form"), F.coalesce(F.bool_or(when(("a", "button"), answers)), F.lit(False)).alias("apply"), F.coalesce(F.max(when("page", F.col("said"))), F.lit("")).alias("whole"),
    )
    blank = {c: F.coalesce(c, F.lit("")) for c in ("h1", "og", "head")}
    every = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("__url"))
    none = F.array().cast("array<string>")
    full = (dealt(every, parts) if parts else every).join(got, "page_id", "left").withColumns(blank | {"headings": F.coalesce("headings", none), "url": F.col("__url"), "form": F.coalesce("form", F.lit(False)), "apply": F.coalesce("apply", F.lit(False)), "whole": F.coalesce("whole", F.lit(""))})
    return full.drop("__url")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id and the text of the posting that a page describes, a line for each block.

    Chrome is left out, and so are lists with three or more links to postings that make up half of their text. Of the rest the
    innermost element around the first h1 with LEAST_BODY letters counts, else the first main part or article, else the page.
    """
    parts = part_count(pages)
    rows = pieces(pages.select("page_id", "url", "html"), parts).where("text is not null and tag is null")
    rows = rows.where(~F.exists(around(), lambda e: tag_of(e["mark"]).isin(*CHROME)))
    size = F.length(squeezed(F.col("text")))
    rows = rows.withColumns({"size": size, "job": F.coalesce(_path(absolute(F.col("url"), F.col("link"))).rlike(JOB_PATH), F.lit(False))})
    spread = rows.select("page_id", "at", "path", "line", "text", "size", "job", "link", F.explode_outer(around()).alias("of"))
    node = Window.partitionBy("page_id", "of.node")
    links = F.size(F.collect_set(F.when(F.col("job"), F.col("link"))).over(node))
    dense = tag_of(F.col("of.mark")).isin(*LISTS) & (links >= 3) & (2 * F.sum(F.when(F.col("job"), F.col("size")).otherwise(0)).over(node) >= F.sum("size").over(node)) & (F.sum("size").over(node) > 0)
    marked = spread.withColumn("dense", F.coalesce(dense, F.lit(False)))
    piece, page = Window.partitionBy("page_id", "at"), Window.partitionBy("page_id")
    left = marked.withColumn("gone", F.max("dense").over(piece)).where("not gone")
    tag, where = tag_of(F.col("of.mark")), F.col("of.node")
    left = left.withColumn("h1", F.min(F.when(tag == "h1", where)).over(page))
    left = left.withColumns({"letters": F.sum("size").over(node), "over": F.coalesce(F.max(F.array_contains("path", F.col("h1")) & (where < F.col("h1"))).over(node), F.lit(False))})
    rank = (
        F.when(F.col("over") & (F.col("letters") >= LEAST_BODY) & ~tag.isin("html", "body"), F.struct(F.lit(3).alias("kind"), F.col("of.depth").alias("order"), where.alias("node")))
        .when(tag.isin("main", "article"), F.struct(F.lit(2).alias("kind"), (-where).alias("order"), where.alias("node")))
    )
    chosen = left.withColumn("body", F.max(rank).over(page)["node"]).where(F.col("body").isNull() | (where == F.col("body")))
    once = chosen.groupBy("page_id", "at").agg(F.first("line").alias("line"), F.first("text").alias("text"))
    lines = once.groupBy("page_id", "line").agg(said(F.col("at"), F.col("text")).alias("said")).where("said <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n")
    got = lines.groupBy("page_id").agg(text.alias("text"))
    every = pages.select(F.col("page_id").cast("long").alias("page_id"))
    return (dealt(every, parts) if parts else every).join(got, "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))


def page_title(html: Column) -> Column:
    """page_titles as a column, by patterns: the first h1 and h2, og:title, the document's title up to a bar or dash."""
    one = lambda pattern: T.collapsed_text(T.html_to_text(F.regexp_extract(html, pattern, 1)))
    head = F.regexp_replace(one(r"(?is)<title[^>]*>(.*?)</title\s*>"), r"\s*(?:\|| - ).*$", "")
    og = T.unescape(F.regexp_extract(html, r"(?is)<meta[^>]*og:title[^>]*content=[\"']([^\"']*)", 1))
    return _first_good(one(r"(?is)<h1[^>]*>(.*?)</h1\s*>"), one(r"(?is)<h2[^>]*>(.*?)</h2\s*>"), og, head)


def marked(html: Column) -> Column:
    """A page of whose references only those of <, > and & are read; others stand as they are written."""
    return F.regexp_replace(html, "&(?!(?:lt|gt|amp);)", "&amp;")


def page_titles(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """page_id and the first title that says something: the h1, what the listing called it, further headings (four of h2 and h3), og:title, the document's up to a bar or dash."""
    rows = kept_pieces(pages, "h1", "h2", "h3", "meta", "title")
    stub = F.lit(None).cast("string")
    if listed is not None:
        rows, stub = rows.join(listed.select("page_id", F.col("title").alias("listed")), "page_id", "left"), F.col("listed")

    def text(element: Column) -> Column:
        inside = F.filter("kept", lambda p: p["text"].isNotNull() & F.array_contains(p["path"], element["at"]))
        return squeezed(F.array_join(F.transform(inside, lambda p: p["text"]), " "))

    def first(most: int, *tags: str) -> Column:
        return F.transform(F.slice(F.filter("kept", lambda p: p["tag"].isin(*tags)), 1, most), text)

    contents = F.transform(F.filter("kept", lambda p: (p["tag"] == "meta") & (p["attributes"]["property"] == "og:title")), lambda p: p["attributes"]["content"])
    og = F.transform(F.slice(F.array_compact(contents), 1, 1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    head = F.transform(first(1, "title"), lambda x: F.trim(F.regexp_replace(x, r"\s*(?:\|| - ).*$", "")))
    good = F.filter(F.concat(first(1, "h1"), F.array(stub), first(4, "h2", "h3"), og, head), lambda t: ~generic_title(t) & (F.length(t) <= MOST_TITLE))
    return rows.select("page_id", F.coalesce(F.get(good, F.lit(0)), stub).alias("title"))


def is_listing_page(pages: DataFrame) -> DataFrame:
    """page_id and links of pages that list several jobs rather than describe one."""
    n = job_links(pages).groupBy("page_id").agg(F.count("*").alias("links"))
    rows = page_heads(pages).select("page_id", "whole", "form", "apply").join(n, "page_id")
    counted, bare = F.col("whole").rlike(RESULTS), ~F.col("form") & ~F.col("apply")
    return rows.where((F.col("links") >= 2) & (counted | ((F.col("links") >= 5) & bare))).select("page_id", "links")


def page_details(pages: DataFrame, stubs: DataFrame | None = None, most_text: int | None = None) -> DataFrame:
    """What each page says of one posting: page_id, title, location_text, employment_type, description, source_published_at, source_updated_at, listing.

    Structured data counts first; a page that lists several jobs (listing) describes none; else title, place and text
    are read from the page. stubs: page_id, title as the listing had it. most_text: where a text is cut; nowhere by default.
    """
    payloads = pages.select(F.col("page_id").alias("source_id"), F.lit(0).cast("long").alias("crawl_id"), "url", F.lit(0).alias("page_no"), F.col("html").alias("body"))
    first = Window.partitionBy("source_id").orderBy("ordinal")
    ld = boards.jsonld_rows(payloads).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    x = F.col("x")
    ld = ld.select(
        F.col("source_id").alias("page_id"), F.nullif(x["title"], F.lit("")).alias("ld_title"), boards.ld_place(x).alias("ld_place"), boards.ld_employment(x).alias("ld_employment"),
        F.nullif(T.html_to_text(x["description"]), F.lit("")).alias("ld_text"), T.parse_timestamp(x["datePosted"]).alias("ld_published"), T.parse_timestamp(x["dateModified"]).alias("ld_updated"),
        F.lit(True).alias("ld"),
    )
    several = is_listing_page(pages).select("page_id", F.lit(True).alias("several"))
    read = page_heads(pages).select("page_id", "h1", "headings", "og", "head").join(page_texts(pages), "page_id")
    stub = stubs.select("page_id", F.col("title").alias("stub")) if stubs is not None else read.select("page_id", F.lit(None).cast("string").alias("stub"))
    rows = read.join(stub, "page_id", "left").join(ld, "page_id", "left").join(several, "page_id", "left")
    has = F.coalesce("ld", F.lit(False))
    listing = ~has & F.coalesce("several", F.lit(False))
    title = F.coalesce(_first_good(F.col("h1"), F.col("stub"), *(F.get("headings", F.lit(k)) for k in range(4)), F.col("og"), F.col("head")), F.col("stub"))
    title = F.when(generic_title(title), F.coalesce(first_title_like_line(F.col("text")), title)).otherwise(title)
    own = lambda structured, read_: F.when(has, structured).when(~listing, read_)
    return rows.select(
        "page_id", own(F.coalesce("ld_title", "stub"), title).alias("title"), own(F.col("ld_place"), guess_location(F.col("text"))).alias("location_text"),
        F.coalesce("ld_employment", F.lit("unknown")).alias("employment_type"), own(F.col("ld_text"), F.nullif(F.col("text") if most_text is None else F.substr("text", F.lit(1), F.lit(most_text)), F.lit(""))).alias("description"),
        F.col("ld_published").alias("source_published_at"), F.col("ld_updated").alias("source_updated_at"), listing.alias("listing"),
    )


def feed_rows(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Objects with a title in JSON that a page loaded: key, at, and the first value found under any of the known names."""
    fields = {"title": ("title", "name", "jobtitle", "position"), "id": ("id", "jobid", "uid", "reqid"), "location": ("location", "city", "office"), "url": ("url", "link", "href", "applyurl")}
    top = F.from_json(body, "map<string,string>")
    items = F.coalesce(F.from_json(body, "array<map<string,string>>"), F.array(top))
    rows = documents.select(key, F.posexplode(items).alias("at", "m"))
    low = F.transform_keys("m", lambda k, _: F.lower(k))
    out = rows.select(key, "at", low.alias("m"))
    pick = lambda names: F.coalesce(*(F.nullif(F.try_element_at("m", F.lit(n)), F.lit("")) for n in names))
    return out.select(key, "at", *(pick(names).alias(c) for c, names in fields.items()))


# Names under which feeds keep a posting's fields, the most telling first; and what a list of postings is.
FEED_KEYS = {
    "title": ("jobtitle", "positionname", "position_name", "title", "position", "name", "tl"),
    "url": ("joburl", "applyurl", "url", "link", "href", "permalink", "slug"),
    "id": ("jobid", "job_id", "positionid", "position_id", "recid", "uid", "id"),
    "location": ("locationname", "location", "city", "area", "region", "site", "ct"),
    "date": ("dateposted", "publishdate", "published", "opendate", "created", "date"),
    "employment": ("employmenttype", "jobtype", "scope", "tp"),
}
FEED_TEXTS = ("jobdescription", "description", "requirements", "summary", "body", "content", "text", "details", "dc")
LEAST_ROWS, LEAST_SHARE = 3, 0.4
#: Levels of a document that lists are looked for in: a step of the plan each, so that there has to be an end.
LEVELS = 6


def feed_value(row: Column, *keys: str) -> Column:
    """The first value among the keys, whatever their case, that is neither empty nor a list; of an object its name, title or value. row: map of JSON texts."""
    low = F.transform_keys(row, lambda k, _: F.lower(k))

    def one(key: str) -> Column:
        value = F.try_element_at(low, F.lit(key))
        inner = F.from_json(value, "name string, title string, value string")
        named = F.coalesce(*(F.nullif(inner[n], F.lit("")) for n in ("name", "title", "value")))
        plain = F.when(value.startswith("{"), named).when(~value.startswith("["), value)
        return F.nullif(plain, F.lit(""))

    return F.coalesce(*map(one, keys))


def feed_lists(documents: DataFrame, key: str, body: str, levels: int = LEVELS) -> DataFrame:
    """key, document, list, n, at, row (map of JSON texts) of every object in a list of LEAST_ROWS or more, up to ``levels`` deep. documents: key, document, body."""
    objects = lambda x: F.ltrim(x).startswith("{")
    level = documents.select(key, "document", F.lit("$").alias("list"), F.col(body).alias("node"))
    found = None
    for depth in range(levels + 1):
        items = F.from_json("node", "array<string>")
        rows = F.filter(items, objects)
        lists = level.where(F.ltrim("node").startswith("[") & (F.size(rows) >= LEAST_ROWS)).select(key, "document", "list", rows.alias("rows"))
        found = lists if found is None else found.unionByName(lists)
        if depth < levels:
            members = F.when(F.ltrim("node").startswith("["), items).when(objects(F.col("node")), F.map_values(F.from_json("node", "map<string,string>")))
            level = level.select(key, "document", "list", F.posexplode(members).alias("k", "node")).where(F.ltrim("node").rlike(r"^[\[{]"))
            level = level.select(key, "document", F.concat("list", F.lit("/"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("list"), "node")
    out = found.select(key, "document", "list", F.posexplode("rows").alias("at", "json"))
    return out.select(key, "document", "list", "at", F.from_json("json", "map<string,string>").alias("row"))


def pick_job_feed(documents: DataFrame, key: str = "page_id", body: str = "body", most: int | None = None, levels: int = LEVELS) -> DataFrame:
    """The rows of the list, of all in a page's documents, whose titles most look like jobs': key, at, row; ties go to the longer, then the first list. Of its rows the first ``most``, or all."""
    rows = feed_lists(documents, key, body, levels).withColumn("title", feed_value(F.col("row"), *FEED_KEYS["title"])).where("title is not null")
    share = F.avg(F.when(T.looks_like_job_title(F.col("title")), 1.0).otherwise(0.0))
    lists = rows.groupBy(key, "document", "list").agg(F.count("*").alias("n"), share.alias("share")).where((F.col("n") >= LEAST_ROWS) & (F.col("share") >= LEAST_SHARE))
    best = Window.partitionBy(key).orderBy(F.desc("share"), F.desc("n"), "document", "list")
    chosen = lists.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(key, "document", "list")
    order = Window.partitionBy(key).orderBy("at")
    kept = rows.join(chosen, [key, "document", "list"], "left_semi")
    if most is not None:
        kept = kept.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return kept.select(key, "at", "row")


def feed_postings(rows: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ordinal, external_job_id, title, location_text, source_url, apply_url, employment_type, description, source_published_at of feed rows."""
    r = rows.join(pages.select(key, F.col("url").alias("page_url")), key)
    get = lambda field: feed_value(F.col("row"), *FEED_KEYS[field])
    link = absolute(F.col("page_url"), F.trim(get("url")))
    link = F.when(link.rlike("^https?://"), link)
    place, title = get("location"), F.trim(get("title"))
    ident = F.coalesce(get("id"), T.url_id(F.concat_ws("|", F.coalesce(link, title), F.coalesce(place, F.lit("None")))))
    texts = F.array(*(F.nullif(T.html_to_text(feed_value(F.col("row"), k)), F.lit("")) for k in FEED_TEXTS))
    return r.where(title != "").select(
        key, F.col("at").cast("long").alias("ordinal"), ident.alias("external_job_id"), title.alias("title"), place.alias("location_text"), F.coalesce(link, "page_url").alias("source_url"), link.alias("apply_url"),
        T.employment_type(get("employment")).alias("employment_type"), F.nullif(F.array_join(F.array_compact(texts), "\n\n"), F.lit("")).alias("description"), T.parse_timestamp(get("date")).alias("source_published_at"),
    )


#: Steps up (..) in one address that are followed.
STEPS_UP = 3


def absolute(base: Column, href: Column) -> Column:
    """href against the page's address, without its fragment."""
    scheme, root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", 0)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    h = F.regexp_replace(href, "#.*$", "")
    out = (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h.startswith("/"), F.concat(root, h))
        .when(h == "", base).otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), h))
    )
    out = F.regexp_replace(out, r"(?<=/)(?:\./)+", "")
    for _ in range(STEPS_UP):
        out = F.regexp_replace(out, r"^([^:]+://[^/?#]+(?:/[^?#]*?)?)/(?:(?!\.\./)[^/?#]+/)?\.\./", "$1/")
    return T.safe_link(out)

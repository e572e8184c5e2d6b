"""Landed answers of hosted job boards as listing and details rows. One branch of from_json for each kind of board."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import DETAILS, LISTING


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _some(x: Column) -> Column:
    """Null for empty text."""
    return F.when(x != "", x)


def _html(x: Column) -> Column:
    return _some(T.html_to_text(x))


def _joined(*parts: Column, by: str = ", ") -> Column:
    return _some(F.concat_ws(by, *(_some(p) for p in parts)))


def _rows(payloads: DataFrame, schema: str, items: str = "") -> DataFrame:
    """One row for each item of the bodies, in the order of pages and items: keep (source_id, crawl_id, url), ordinal, x."""
    body = F.from_json("body", schema)
    if items is None:
        return payloads.select("source_id", "crawl_id", "url", F.col("page_no").cast("long").alias("ordinal"), body.alias("x")).where("x is not null")
    many = body[items] if items else body
    out = payloads.select("source_id", "crawl_id", "url", "page_no", F.posexplode(many).alias("at", "x"))
    return out.select("source_id", "crawl_id", "url", (F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("at")).alias("ordinal"), "x")


def _listing(rows: DataFrame, ident: Column, title: Column, place: Column, link: Column, apply: Column, updated: Column | None = None, published: Column | None = None) -> DataFrame:
    updated, published = (_null("timestamp") if x is None else x for x in (updated, published))
    return rows.where(ident.isNotNull()).select(
        "source_id", "crawl_id", "ordinal", ident.cast("string").alias("external_job_id"), F.coalesce(title, F.lit("")).alias("title"), _some(place).alias("location_text"),
        F.coalesce(_some(link), "url").alias("source_url"), _some(apply).alias("apply_url"), updated.alias("source_updated_at"),
        published.alias("source_published_at"),
    )


def _details(rows: DataFrame, ident: Column, title: Column, **columns: Column) -> DataFrame:
    names = [f.split()[0] for f in DETAILS.split(", ")]
    kinds = {f.split()[0]: f.split()[1] for f in DETAILS.split(", ")}
    given = {"source_id": F.col("source_id"), "crawl_id": F.col("crawl_id"), "external_job_id": ident.cast("string"), "title": title, "remote_type": F.lit("unknown"), "employment_type": F.lit("unknown"), **columns}
    return rows.where(ident.isNotNull()).select(*(given.get(n, _null()).cast(kinds[n]).alias(n) for n in names))


# --- greenhouse ---

_GREENHOUSE = "id:string,title:string,location:struct<name:string>,absolute_url:string,updated_at:string,content:string,departments:array<struct<name:string>>"


def greenhouse_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_rows(p, f"jobs array<struct<{_GREENHOUSE}>>", "jobs"), x["id"], x["title"], x["location"]["name"], x["absolute_url"], x["absolute_url"], T.parse_timestamp(x["updated_at"]))


def greenhouse_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = _rows(p, ", ".join(f.replace(":", " ", 1) for f in ("id:string", "title:string", "location:struct<name:string>", "absolute_url:string", "updated_at:string", "content:string", "departments:array<struct<name:string>>")), None)
    return _details(
        rows, x["id"], x["title"], department=_some(F.get(x["departments"], 0)["name"]), location_text=x["location"]["name"], description=_html(T.unescape(x["content"])),
        source_url=x["absolute_url"], apply_url=x["absolute_url"], source_updated_at=T.parse_timestamp(x["updated_at"]),
    )


# --- lever: the list carries everything ---

_LEVER = (
    "array<struct<id:string,text:string,categories:struct<location:string,team:string,department:string,commitment:string>,hostedUrl:string,applyUrl:string,createdAt:string,"
    "descriptionPlain:string,description:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,additional:string>>"
)


def lever_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_rows(p, _LEVER), x["id"], x["text"], x["categories"]["location"], x["hostedUrl"], x["applyUrl"])


def lever_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    sections = F.transform(F.coalesce(x["lists"], F.expr("cast(array() as array<struct<text:string,content:string>>)")), lambda s: F.concat_ws("\n", _some(s["text"]), _html(s["content"])))
    first = F.coalesce(_some(x["descriptionPlain"]), _html(x["description"]))
    last = F.coalesce(_some(x["additionalPlain"]), _html(x["additional"]))
    parts = F.filter(F.concat(F.array(first), sections, F.array(last)), lambda s: s.isNotNull() & (s != ""))
    return _details(
        _rows(p, _LEVER), x["id"], x["text"], department=F.coalesce(_some(x["categories"]["team"]), _some(x["categories"]["department"])), location_text=x["categories"]["location"],
        employment_type=T.employment_type(x["categories"]["commitment"]), description=_some(F.array_join(parts, "\n\n")), source_url=x["hostedUrl"], apply_url=x["applyUrl"],
        source_published_at=T.parse_timestamp(x["createdAt"]),
    )


# --- ashby ---

_ASHBY = (
    "jobs array<struct<id:string,title:string,location:string,department:string,team:string,jobUrl:string,applyUrl:string,publishedAt:string,updatedAt:string,"
    "employmentType:string,descriptionPlain:string,descriptionHtml:string>>"
)


def ashby_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_rows(p, _ASHBY, "jobs"), x["id"], x["title"], x["location"], x["jobUrl"], x["applyUrl"], T.parse_timestamp(F.coalesce(_some(x["updatedAt"]), x["publishedAt"])))


def ashby_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _details(
        _rows(p, _ASHBY, "jobs"), x["id"], x["title"], department=x["department"], location_text=x["location"], employment_type=T.employment_type(x["employmentType"]),
        description=F.coalesce(_some(x["descriptionPlain"]), _html(x["descriptionHtml"])), source_url=x["jobUrl"], apply_url=x["applyUrl"],
        source_published_at=T.parse_timestamp(x["publishedAt"]), source_updated_at=T.parse_timestamp(F.coalesce(_some(x["updatedAt"]), x["publishedAt"])),
    )


# --- smartrecruiters ---

_PLACE = "struct<fullLocation:string,city:string,region:string,country:string,remote:boolean,hybrid:boolean>"


def _smart_place(x: Column) -> Column:
    return F.coalesce(_some(x["fullLocation"]), _joined(x["city"], x["region"], x["country"]))


def smartrecruiters_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_rows(p, f"content array<struct<id:string,name:string,location:{_PLACE}>>", "content"), x["id"], F.trim(x["name"]), _smart_place(x["location"]), _null(), _null())


def smartrecruiters_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    part = "struct<text:string>"
    rows = _rows(
        p,
        f"id string, name string, location {_PLACE}, department struct<label:string>, typeOfEmployment struct<label:string>, postingUrl string, applyUrl string, releasedDate string, "
        f"jobAd struct<sections:struct<companyDescription:{part},jobDescription:{part},additionalInformation:{part},qualifications:{part}>>",
        None,
    )
    s = x["jobAd"]["sections"]
    return _details(
        rows, x["id"], F.trim(x["name"]), department=x["department"]["label"], location_text=_smart_place(x["location"]),
        remote_type=F.when(x["location"]["remote"], "remote").when(x["location"]["hybrid"], "hybrid").otherwise("unknown"), employment_type=T.employment_type(x["typeOfEmployment"]["label"]),
        description=_joined(T.html_to_text(s["companyDescription"]["text"]), T.html_to_text(s["jobDescription"]["text"]), T.html_to_text(s["additionalInformation"]["text"]), by="\n\n"),
        qualifications=_html(s["qualifications"]["text"]), source_url=x["postingUrl"], apply_url=F.coalesce(x["applyUrl"], x["postingUrl"]), source_published_at=T.parse_timestamp(x["releasedDate"]),
    )


# --- workable: a row for each place, the short code is the posting ---

_WORKABLE = (
    "jobs array<struct<shortcode:string,title:string,city:string,country:string,url:string,application_url:string,telecommuting:boolean,employment_type:string,published_on:string,department:string>>"
)


def _workable_rows(p: DataFrame) -> DataFrame:
    first = Window.partitionBy("source_id", "crawl_id", F.col("x.shortcode")).orderBy("ordinal")
    return _rows(p, _WORKABLE, "jobs").where("x.shortcode is not null").withColumn("__n", F.row_number().over(first)).where("__n = 1")


def workable_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_workable_rows(p), x["shortcode"], x["title"], _joined(x["city"], x["country"]), x["url"], F.coalesce(_some(x["application_url"]), x["url"]))


def workable_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = _rows(p, "shortcode string, title string, location struct<city:string,country:string>, department array<string>, description string, benefits string, requirements string, workplace string, remote boolean", None)
    benefits = _html(x["benefits"])
    remote = F.when(T.remote_type(x["workplace"]) != "unknown", T.remote_type(x["workplace"])).when(x["remote"], "remote").otherwise("unknown")
    return _details(
        rows, x["shortcode"], x["title"], department=_some(F.array_join(x["department"], ", ")), location_text=_joined(x["location"]["city"], x["location"]["country"]), remote_type=remote,
        description=_joined(T.html_to_text(x["description"]), F.concat(F.lit("Benefits\n"), benefits), by="\n\n"), qualifications=_html(x["requirements"]),
    )


# --- comeet: named sections ---

_COMEET = "uid:string,name:string,location:struct<name:string>,department:string,employment_type:string,url_active_page:string,time_updated:string,details:array<struct<name:string,value:string>>"


def comeet_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_rows(p, f"array<struct<{_COMEET}>>"), x["uid"], x["name"], x["location"]["name"], x["url_active_page"], x["url_active_page"], T.parse_timestamp(x["time_updated"]))


def comeet_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    sections = F.transform(F.coalesce(x["details"], F.expr("cast(array() as array<struct<name:string,value:string>>)")), lambda s: F.struct(F.trim(s["name"]).alias("name"), T.html_to_text(s["value"]).alias("text")))
    named = lambda n: _some(F.get(F.filter(sections, lambda s: F.lower(s["name"]) == n), 0)["text"])
    rest = F.filter(sections, lambda s: ~F.lower(s["name"]).isin("responsibilities", "requirements") & (s["text"] != ""))
    shown = F.transform(rest, lambda s: F.when(F.lower(s["name"]) == "description", s["text"]).otherwise(F.concat_ws("\n", s["name"], s["text"])))
    return _details(
        _rows(p, f"array<struct<{_COMEET}>>"), x["uid"], x["name"], department=x["department"], location_text=x["location"]["name"], employment_type=T.employment_type(x["employment_type"]),
        description=_some(F.array_join(shown, "\n\n")), responsibilities=named("responsibilities"), qualifications=named("requirements"), source_url=x["url_active_page"],
        apply_url=x["url_active_page"], source_updated_at=T.parse_timestamp(x["time_updated"]),
    )


# --- workday ---


def workday_job_id(path: Column) -> Column:
    """The token after the last underscore of a path's last part: it stays when the title changes."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/_]*)$", 1)


def workday_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = _rows(p, "jobPostings array<struct<title:string,externalPath:string,locationsText:string>>", "jobPostings")
    link = F.concat(F.regexp_replace("url", "/+$", ""), x["externalPath"])
    return _listing(rows, F.when(x["externalPath"] != "", workday_job_id(x["externalPath"])), x["title"], x["locationsText"], link, link)


def workday_place(location: Column, more: Column, country: Column, target: str = "Israel") -> Column:
    """The offices in the country that was asked for, or all of them and the country."""
    every = F.filter(F.concat(F.array(location), F.coalesce(more, F.array())), lambda x: x.isNotNull() & (x != ""))
    here = F.filter(every, lambda x: F.lower(x).contains(target.lower()))
    named = F.exists(every, lambda x: F.lower(x).contains(F.lower(country)))
    full = F.when(F.coalesce(country, F.lit("")) != "", F.when(named, every).otherwise(F.concat(every, F.array(country)))).otherwise(every)
    return F.when(F.size(here) > 0, F.array_join(here, ", ")).otherwise(F.array_join(full, ", "))


def workday_details(p: DataFrame) -> DataFrame:
    x = F.col("x.jobPostingInfo")
    rows = _rows(p, "jobPostingInfo struct<title:string,location:string,additionalLocations:array<string>,country:struct<descriptor:string>,remoteType:string,timeType:string,jobDescription:string,externalUrl:string,startDate:string,externalPath:string>", None)
    return _details(
        rows, workday_job_id(F.coalesce(x["externalPath"], "url")), x["title"], location_text=_some(workday_place(x["location"], x["additionalLocations"], x["country"]["descriptor"])),
        remote_type=T.remote_type(x["remoteType"]), employment_type=T.employment_type(x["timeType"]), description=_html(x["jobDescription"]), source_url=x["externalUrl"], apply_url=x["externalUrl"],
        source_published_at=T.parse_timestamp(x["startDate"]),
    )


# --- pages with embedded structured data ---

_LD = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
LD_LEVELS = 4
_POSTING = (
    "struct<`@type`:string,title:string,url:string,description:string,datePosted:string,dateModified:string,employmentType:string,identifier:string,jobLocation:string,hiringOrganization:string,qualifications:string,responsibilities:string>"
)


def jsonld_rows(p: DataFrame) -> DataFrame:
    """Job postings in a page's structured data: single ones, and lists and graphs of them, LD_LEVELS deep."""
    nodes = F.regexp_extract_all("body", F.lit(_LD), F.lit(1))
    for _ in range(LD_LEVELS):
        nodes = F.flatten(F.transform(nodes, _opened))
    fields = _POSTING.removeprefix("struct<").removesuffix(">").replace(":string", " string")
    rows = p.select("source_id", "crawl_id", "url", "page_no", F.posexplode(nodes).alias("at", "json")).withColumn("x", F.from_json("json", fields))
    rows = rows.where(F.col("x.@type").contains("JobPosting"))
    return rows.select("source_id", "crawl_id", "url", (F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("at")).alias("ordinal"), "x")


def _opened(node: Column) -> Column:
    """What a list or a graph holds, or the node itself."""
    graph = F.from_json(node, "`@graph` array<string>")["@graph"]
    return F.when(F.ltrim(node).startswith("["), F.coalesce(F.from_json(node, "array<string>"), F.array(node))).otherwise(F.coalesce(graph, F.array(node)))


def ld_place(x: Column) -> Column:
    """Locality, region and country of the first place."""
    first = lambda name: _some(F.regexp_extract(x["jobLocation"], rf'"{name}"\s*:\s*(?:\{{[^}}]*"name"\s*:\s*)?"([^"]*)"', 1))
    return _joined(F.coalesce(first("addressLocality"), F.lit("")), F.coalesce(first("addressRegion"), F.lit("")), F.coalesce(first("addressCountry"), F.lit("")))


def _ld_id(x: Column) -> Column:
    value = F.coalesce(_some(F.regexp_extract(x["identifier"], r'"value"\s*:\s*"?([^",}]+)', 1)), F.when(~x["identifier"].startswith("{"), _some(x["identifier"])))
    return F.coalesce(value, _some(x["url"]), T.url_id(F.concat_ws("|", x["title"], F.coalesce(ld_place(x), F.lit("")))))


def ld_employment(x: Column) -> Column:
    """Of the schema's own words, else of words as people write them."""
    kind = F.upper(F.coalesce(x["employmentType"], F.lit("")))
    own = F.when(kind.contains("FULL_TIME"), "full_time").when(kind.contains("PART_TIME"), "part_time").when(kind.contains("CONTRACT"), "contract").when(kind.contains("TEMPORARY"), "temporary").when(kind.contains("INTERN"), "internship")
    return F.coalesce(own, T.employment_type(x["employmentType"]))


def jsonld_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(jsonld_rows(p), _ld_id(x), x["title"], ld_place(x), x["url"], x["url"])


def jsonld_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _details(
        jsonld_rows(p), _ld_id(x), x["title"], location_text=ld_place(x), employment_type=ld_employment(x), description=_html(x["description"]),
        responsibilities=_html(x["responsibilities"]), qualifications=_html(x["qualifications"]), source_url=x["url"], apply_url=x["url"], source_published_at=T.parse_timestamp(x["datePosted"]), source_updated_at=T.parse_timestamp(x["dateModified"]),
    )


# --- posts of a site's own content system ---

_POSTS = "array<struct<id:string,link:string,date_gmt:string,modified_gmt:string,title:struct<rendered:string>,content:struct<rendered:string>>>"


def wordpress_listing(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _listing(_rows(p, _POSTS), F.when(x["link"] != "", T.url_id(x["link"])), T.html_to_text(x["title"]["rendered"]), _null(), x["link"], x["link"], T.parse_timestamp(x["modified_gmt"]))


def wordpress_details(p: DataFrame) -> DataFrame:
    x = F.col("x")
    return _details(_rows(p, _POSTS), F.when(x["link"] != "", T.url_id(x["link"])), T.html_to_text(x["title"]["rendered"]), description=_html(x["content"]["rendered"]), source_url=x["link"], apply_url=x["link"], source_published_at=T.parse_timestamp(x["date_gmt"]), source_updated_at=T.parse_timestamp(x["modified_gmt"]))


# --- taleo: columns of a requisition, fields of a script's string array ---


def taleo_place(x: Column) -> Column:
    """IL-IL-Tel Aviv as Tel Aviv, IL."""
    parts = F.filter(F.transform(F.split(x, "-"), lambda p: F.trim(p)), lambda p: p != "")
    coded = (F.size(parts) >= 3) & (F.length(parts[0]) == 2)
    return F.when(coded, F.concat(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "-"), F.lit(", "), parts[0])).otherwise(x)


def taleo_listing(p: DataFrame) -> DataFrame:
    """body: requisitionList of columns; linkedColumn is the title's, locationsColumns those of places, and of the others one shows the day."""
    x = F.col("x")
    rows = _rows(p, "requisitionList array<struct<jobId:string,contestNo:string,linkedColumn:int,locationsColumns:array<int>,column:array<string>>>", "requisitionList")
    # Answers that do not say which column is which have the title first and the places second.
    places, title_at = F.coalesce(x["locationsColumns"], F.array(F.lit(1))), F.coalesce(x["linkedColumn"], F.lit(0))
    raw = F.get(x["column"], F.coalesce(F.get(places, F.lit(0)), F.lit(-1)))
    place = F.when(raw.startswith("["), F.coalesce(F.get(F.from_json(raw, "array<string>"), F.lit(0)), raw)).otherwise(raw)
    others = F.filter(x["column"], lambda c, i: (i != title_at) & ~F.array_contains(places, i) & c.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"))
    ident = F.coalesce(_some(x["contestNo"]), x["jobId"])
    root, section = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract("url", r"/careersection/([^/?#]+)", 1)
    link = F.when(section != "", F.concat(root, F.lit("/careersection/"), section, F.lit("/jobdetail.ftl?job="), ident, F.lit("&lang=en")))
    return _listing(rows, ident, F.get(x["column"], title_at), taleo_place(place), link, link, None, T.display_date(F.get(others, F.lit(0))))


# The call whose array of strings holds a requisition, and the places of its fields there.
_FILL = r"(?s)fillList\(\s*'requisitionDescriptionInterface'\s*,\s*'descRequisition'\s*,\s*\[(.*?)\]\s*\)"
_TALEO_FIELDS = {"title": 9, "description": 11, "qualifications": 12, "location": 13}


def taleo_details(p: DataFrame) -> DataFrame:
    """body: the page of one requisition, whose address names it."""
    fields = js_strings(F.regexp_extract("body", _FILL, 1))
    rows = p.select("source_id", "crawl_id", "url", fields.alias("fields")).where(F.size("fields") > 0)
    field = {n: F.get("fields", F.lit(k)) for n, k in _TALEO_FIELDS.items()}
    ident = _some(F.regexp_extract("url", r"[?&]job=([^&#]+)", 1))
    return _details(rows, ident, _some(field["title"]), location_text=taleo_place(_some(field["location"])), description=_html(decode_field(field["description"])), qualifications=_html(decode_field(field["qualifications"])), source_url=F.col("url"), apply_url=F.col("url"))


def js_strings(x: Column) -> Column:
    """The single-quoted strings of a script's array. Possessive, as a pattern that may turn back goes one call deeper with each character."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?s)'([^'\\]*+(?:\\.[^'\\]*+)*+)'"), F.lit(1)), lambda s: F.regexp_replace(s, r"\\(.)", "$1"))


def decode_field(x: Column) -> Column:
    """A field that is URL-encoded after a mark."""
    return F.when(x.startswith("!*!"), F.coalesce(F.try_url_decode(F.substr(x, F.lit(4))), F.substr(x, F.lit(4)))).otherwise(x)


# --- feeds that company sites publish themselves: the list carries everything ---

# Hosts of the feeds and the addresses of their postings.
_ELBIT, _IAI, _AMAZON = "elbitsystemscareer.com", "jobs.iai.co.il", "amazon.jobs"


def _of_host(p: DataFrame, host: str) -> DataFrame:
    return p.where(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)).rlike(rf"(?:^|\.){host.replace('.', chr(92) + '.')}$"))


def _in_country(city: Column, otherwise: Column | None = None) -> Column:
    return F.when(city != "", F.concat(city, F.lit(", Israel"))).otherwise(F.lit("Israel") if otherwise is None else otherwise)


def _feeds(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = F.col("x")
    elbit = _rows(_of_host(p, _ELBIT), "array<struct<jobId:string,jobTitle:string,area:string,updateDate:string,openDate:string,employmentType:string,description:string,requirements:string>>").where(x["jobId"] != "")
    iai = _rows(_of_host(p, _IAI), "array<struct<id:string,tl:string,ct:string,tp:string,dc:string>>").where(x["id"] != "")
    fields = "id_icims:string,title:string,city:string,location:string,job_path:string,url_next_step:string,job_category:string,is_intern:boolean,job_schedule_type:string,description:string,preferred_qualifications:string,basic_qualifications:string,posted_date:string"
    amazon = _rows(_of_host(p, _AMAZON), f"jobs array<struct<{fields}>>", "jobs").where(x["id_icims"] != "")
    return elbit, iai, amazon


def _feed_links() -> tuple[Column, Column, Column]:
    x = F.col("x")
    return F.concat(F.lit(f"https://{_ELBIT}/jobs/?jobId="), x["jobId"]), F.concat(F.lit(f"https://{_IAI}/job/"), x["id"], F.lit("/")), F.concat(F.lit(f"https://www.{_AMAZON}"), F.coalesce(x["job_path"], F.lit("")))


def site_feed_listing(p: DataFrame) -> DataFrame:
    x, (elbit, iai, amazon), (a, b, c) = F.col("x"), _feeds(p), _feed_links()
    first = _listing(elbit, x["jobId"], x["jobTitle"], _in_country(x["area"]), a, a, T.parse_timestamp(x["updateDate"]))
    second = _listing(iai, x["id"], x["tl"], _in_country(x["ct"]), b, b)
    third = _listing(amazon, x["id_icims"], x["title"], _in_country(x["city"], x["location"]), c, F.coalesce(_some(x["url_next_step"]), c))
    return first.unionByName(second).unionByName(third)


def site_feed_details(p: DataFrame) -> DataFrame:
    x, (elbit, iai, amazon), (a, b, c) = F.col("x"), _feeds(p), _feed_links()
    first = _details(
        elbit, x["jobId"], F.coalesce(x["jobTitle"], F.lit("")), location_text=_in_country(x["area"]), employment_type=T.employment_type(x["employmentType"]), description=_html(x["description"]),
        qualifications=_html(x["requirements"]), source_url=a, apply_url=a, source_published_at=T.parse_timestamp(x["openDate"]), source_updated_at=T.parse_timestamp(x["updateDate"]),
    )
    second = _details(iai, x["id"], F.coalesce(x["tl"], F.lit("")), location_text=_in_country(x["ct"]), employment_type=T.employment_type(x["tp"]), description=_some(x["dc"]), source_url=b, apply_url=b)
    preferred = F.concat(F.lit("Preferred qualifications\n"), _html(x["preferred_qualifications"]))
    third = _details(
        amazon, x["id_icims"], F.coalesce(x["title"], F.lit("")), department=x["job_category"], location_text=_in_country(x["city"], x["location"]),
        employment_type=F.when(x["is_intern"], "internship").otherwise(T.employment_type(x["job_schedule_type"])), description=_joined(T.html_to_text(x["description"]), preferred, by="\n\n"),
        qualifications=_html(x["basic_qualifications"]), source_url=c, apply_url=F.coalesce(_some(x["url_next_step"]), c), source_published_at=T.display_date(x["posted_date"]),
    )
    return first.unionByName(second).unionByName(third)


TYPES: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame] | None]] = {
    "greenhouse": (greenhouse_listing, greenhouse_details), "lever": (lever_listing, lever_details), "ashby": (ashby_listing, ashby_details),
    "smartrecruiters": (smartrecruiters_listing, smartrecruiters_details), "workable": (workable_listing, workable_details), "comeet": (comeet_listing, comeet_details),
    "workday": (workday_listing, workday_details), "jsonld": (jsonld_listing, jsonld_details), "wordpress": (wordpress_listing, wordpress_details), "taleo": (taleo_listing, taleo_details),
    "site_feed": (site_feed_listing, site_feed_details),
}


def register_source_type(name: str, listing: Callable[[DataFrame], DataFrame], details: Callable[[DataFrame], DataFrame] | None = None) -> None:
    TYPES[name] = (listing, details)


#: Types whose list carries the details of each posting.
LISTED_WHOLE = ("lever", "ashby", "jsonld", "wordpress", "comeet", "site_feed")


def land_payloads(payloads: DataFrame, path: str) -> None:
    """Writes answers where the branches below read only those of their own type: each answer is read once for each of the two tables."""
    payloads.write.mode("append").partitionBy("source_type", "kind").parquet(path)


def _all(payloads: DataFrame, schema: str, parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts. By halves, as the plan is gone through once more for each union on top of another."""
    if len(parts) <= 1:
        return payloads.sparkSession.createDataFrame([], schema).unionByName(parts[0]) if parts else payloads.sparkSession.createDataFrame([], schema)
    half = len(parts) // 2
    return _all(payloads, schema, parts[:half]).unionByName(_all(payloads, schema, parts[half:]))


def listing_from_payloads(payloads: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """Listing rows of all known types of sources, or of some. payloads as in schemas.PAYLOADS, best landed by land_payloads."""
    names = TYPES if types is None else types
    return _all(payloads, LISTING, [TYPES[name][0](payloads.where((F.col("source_type") == name) & (F.col("kind") == "listing"))) for name in names])


def details_from_payloads(payloads: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    found = []
    for name in TYPES if types is None else types:
        if details := TYPES[name][1]:
            kinds = ["details", "listing"] if name in LISTED_WHOLE else ["details"]
            found.append(details(payloads.where((F.col("source_type") == name) & F.col("kind").isin(kinds))))
    return _all(payloads, DETAILS, found)

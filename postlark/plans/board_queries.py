"""Registered queries of what boards say of their postings, of addresses, and of boards behind pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import companies
from ..operators.tables import shared_folder
from ..sources import boards
from .registry import at, query
from .views import table

_KINDS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "comeet", "workday", "wordpress", "taleo", "jsonld", "site_feed", "site_feed", "site_feed")


def _of(**fields: Column | str) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each customer as a posting, in an answer of one of ten kinds of boards and three feeds; the number decides the kind. Landed, then read."""
    c = table(spark, d, "customer")
    ident, title, team, place = F.col("c_custkey").cast("string"), F.concat(F.lit("Dev "), "c_name"), F.col("c_mktsegment"), F.lit("Haifa")
    said = F.concat(F.lit("Text of "), ident)
    html = F.concat(F.lit("<p>"), said, F.lit("</p>"))
    link = F.concat(F.lit("https://x/j/"), ident)
    created = ((F.lit(1_704_067_200) + F.col("c_custkey")) * 1000).cast("string")
    section = lambda text: _of(text=text)
    posting = _of(**{"@type": "JobPosting"}, title=title, identifier=_of(value=ident), description=html, qualifications="q", employmentType="FULL_TIME", jobLocation=_of(address=_of(addressLocality=place)))
    fields = ["''"] * 9 + [F.concat(F.lit("'"), title, F.lit("'")), "''", F.concat(F.lit("'!*!%3Cp%3EText%20of%20"), ident, F.lit("%3C%2Fp%3E'")), "'!*!q'", "'IL-IL-Haifa'"]
    bodies = [
        F.to_json(_of(id=ident, title=title, location=_of(name=place), absolute_url=link, content=F.concat(F.lit("&lt;p&gt;"), said, F.lit("&lt;/p&gt;")), departments=F.array(_of(name=team)))),
        F.to_json(F.array(_of(
            id=ident, text=title, categories=_of(location=place, team=team, commitment="Full-time"), createdAt=created, descriptionPlain=said,
            lists=F.array(_of(text="You", content=F.concat(F.lit("<li>a</li><li>"), ident, F.lit("</li>")))), additional="<p>end</p>",
        ))),
        F.to_json(_of(jobs=F.array(_of(id=ident, title=title, location=place, department=team, employmentType="PartTime", descriptionHtml=F.concat(html, F.lit("<p>more &amp; more</p>")))))),
        F.to_json(_of(
            id=ident, name=F.concat(F.lit(" "), title), location=_of(city=place, region="", country="il", remote=F.lit(True)), department=_of(label=team), typeOfEmployment=_of(label="Intern"),
            jobAd=_of(sections=_of(companyDescription=section("<p>About</p>"), jobDescription=section(html), qualifications=section("<ul><li>q</li></ul>"))),
        )),
        F.to_json(_of(shortcode=ident, title=title, location=_of(city=place, country="Israel"), department=F.array(team, F.lit("R")), description=html, benefits="<p>lunch</p>", requirements="<p>q</p>", workplace="hybrid")),
        F.to_json(F.array(_of(
            uid=ident, name=title, location=_of(name=place), department=team, employment_type="Contractor",
            details=F.array(_of(name="Description", value=html), _of(name="Requirements", value="<p>q</p>"), _of(name="Perks", value="p")),
        ))),
        F.to_json(_of(jobPostingInfo=_of(
            title=title, location="Haifa, Israel", additionalLocations=F.array(F.lit("Berlin")), country=_of(descriptor="Israel"), remoteType="Hybrid", timeType="Full time", jobDescription=html,
            externalPath=F.concat(F.lit("/job/x_"), ident),
        ))),
        F.to_json(F.array(_of(id=ident, link=link, title=_of(rendered=title), content=_of(rendered=html)))),
        F.concat(F.lit("<script>fillList('requisitionDescriptionInterface', 'descRequisition', ["), F.concat_ws(",", *(F.lit(f) if isinstance(f, str) else f for f in fields)), F.lit("])</script>")),
        F.concat(F.lit('<script type="application/ld+json">'), F.to_json(_of(**{"@graph": F.array(F.array(posting))})), F.lit("</script>")),
        F.to_json(F.array(_of(jobId=ident, jobTitle=title, area=place, employmentType="full", description=html, requirements="q"))),
        F.to_json(F.array(_of(id=ident, tl=title, ct="Lod", tp="part", dc=said))),
        F.to_json(_of(jobs=F.array(_of(id_icims=ident, title=title, city=place, job_path=F.concat(F.lit("/j/"), ident), job_category=team, is_intern=F.lit(True), description=html, preferred_qualifications="pq", basic_qualifications="q")))),
    ]
    urls = ["https://x"] * 8 + [F.concat(F.lit("https://x/careersection/2/jobdetail.ftl?job="), ident), "https://x", "https://elbitsystemscareer.com/api", "https://jobs.iai.co.il/api", "https://www.amazon.jobs/api"]
    kind = (F.col("c_custkey") % len(_KINDS)).cast("int")
    pick = lambda options: F.get(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), kind)
    source_type = pick(_KINDS)
    rows = c.select(
        F.col("c_custkey").alias("source_id"), source_type.alias("source_type"), F.lit(1).cast("long").alias("crawl_id"), F.when(source_type.isin(*boards.LISTED_WHOLE), "listing").otherwise("details").alias("kind"),
        F.lit(0).alias("page_no"), pick(urls).alias("url"), at().alias("fetched_at"), pick(bodies).alias("body"),
    )
    folder = shared_folder(spark, "answers")
    boards.land_payloads(rows, folder)
    return spark.read.parquet(folder)


_ANSWERS_SQL = "a AS (SELECT c_custkey AS n, c_custkey % 13 AS k, CAST(c_custkey AS VARCHAR) AS i, c_name, c_mktsegment AS team, concat('Text of ', c_custkey) AS said FROM customer)"


@query(f"""WITH {_ANSWERS_SQL} SELECT n AS source_id, CASE WHEN k = 7 THEN substr(sha256(concat('https://x/j/', i)), 1, 32) ELSE i END AS external_job_id, concat('Dev ', c_name) AS title,
  CASE WHEN k IN (0, 1, 2, 3, 5, 12) THEN team WHEN k = 4 THEN concat(team, ', R') END AS department,
  CASE k WHEN 3 THEN 'Haifa, il' WHEN 4 THEN 'Haifa, Israel' WHEN 6 THEN 'Haifa, Israel' WHEN 7 THEN NULL WHEN 8 THEN 'Haifa, IL' WHEN 10 THEN 'Haifa, Israel' WHEN 11 THEN 'Lod, Israel' WHEN 12 THEN 'Haifa, Israel' ELSE 'Haifa' END AS location_text,
  CASE k WHEN 3 THEN 'remote' WHEN 4 THEN 'hybrid' WHEN 6 THEN 'hybrid' ELSE 'unknown' END AS remote_type,
  CASE k WHEN 1 THEN 'full_time' WHEN 2 THEN 'part_time' WHEN 3 THEN 'internship' WHEN 5 THEN 'contract' WHEN 6 THEN 'full_time' WHEN 9 THEN 'full_time' WHEN 10 THEN 'full_time' WHEN 11 THEN 'part_time' WHEN 12 THEN 'internship' ELSE 'unknown' END AS employment_type,
  CASE k WHEN 1 THEN concat(said, chr(10), chr(10), 'You', chr(10), 'a', chr(10), i, chr(10), chr(10), 'end') WHEN 2 THEN concat(said, chr(10), 'more & more') WHEN 3 THEN concat('About', chr(10), chr(10), said)
    WHEN 4 THEN concat(said, chr(10), chr(10), 'Benefits', chr(10), 'lunch') WHEN 5 THEN concat(said, chr(10), chr(10), 'Perks', chr(10), 'p') WHEN 12 THEN concat(said, chr(10), chr(10), 'Preferred qualifications', chr(10), 'pq') ELSE said END AS description,
  CASE WHEN k IN (3, 4, 5, 8, 9, 10, 12) THEN 'q' END AS qualifications, CASE WHEN k = 1 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n) END AS source_published_at FROM a""")
def board_details(spark, d):
    """What ten kinds of boards and three feeds say of a posting, read into one schema."""
    rows = boards.details_from_payloads(_answers(spark, d), dict.fromkeys(_KINDS))
    return rows.select("source_id", "external_job_id", "title", "department", "location_text", "remote_type", "employment_type", "description", "qualifications", "source_published_at")


@query(f"""WITH {_ANSWERS_SQL} SELECT n AS source_id, i AS external_job_id, concat('Dev ', c_name) AS title, CASE k WHEN 11 THEN 'Lod, Israel' ELSE 'Haifa, Israel' END AS location_text,
  CASE k WHEN 10 THEN concat('https://elbitsystemscareer.com/jobs/?jobId=', i) WHEN 11 THEN concat('https://jobs.iai.co.il/job/', i, '/') ELSE concat('https://www.amazon.jobs/j/', i) END AS source_url FROM a WHERE k >= 10""")
def feed_listings(spark, d):
    return boards.listing_from_payloads(_answers(spark, d), ["site_feed"]).select("source_id", "external_job_id", "title", "location_text", "source_url")


def _by_rest(key: str, options: list[Column | str]) -> Column:
    return F.get(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (F.col(key) % len(options)).cast("int"))


@query("""WITH a AS (SELECT s_suppkey, s_suppkey % 11 AS k, concat('acme', s_suppkey) AS n FROM supplier),
  u AS (SELECT *, CASE k WHEN 0 THEN concat('https://boards.greenhouse.io/', n, '/jobs/1') WHEN 1 THEN concat('https://boards.greenhouse.io/embed/job_board?for=', n) WHEN 2 THEN concat('jobs.lever.co/', n) WHEN 3 THEN concat('https://www.comeet.com/jobs/', n, '/12.345')
    WHEN 4 THEN concat('https://', n, '.wd3.myworkdayjobs.com/en-US/Careers/job/x') WHEN 5 THEN concat('https://', n, '.taleo.net/careersection/2/jobsearch.ftl') WHEN 6 THEN concat('https://www.linkedin.com/company/', n) WHEN 7 THEN concat('  https://', n, '.example.com/careers ')
    WHEN 8 THEN concat('https://www.amazon.jobs/en/', n) WHEN 9 THEN concat('javascript:', n) ELSE '' END AS given FROM a)
  SELECT s_suppkey, CASE k WHEN 2 THEN concat('https://', given) WHEN 9 THEN concat('https://', given) WHEN 10 THEN NULL ELSE trim(given) END AS url,
    list_extract(['greenhouse', 'greenhouse', 'lever', 'comeet', 'workday', 'taleo', 'unsupported', 'generic_html', 'site_feed', 'generic_html', 'unsupported'], k + 1) AS kind,
    CASE WHEN k IN (0, 1, 2, 5) THEN n WHEN k = 3 THEN '12.345' WHEN k = 4 THEN concat(n, '/Careers') WHEN k = 8 THEN 'amazon' END AS identifier, CASE WHEN k <> 9 THEN given END AS safe FROM u""")
def addresses_read(spark, d):
    """Addresses as people write them: their full form, the board behind each, its name there, and whether they may be shown as links."""
    n = F.concat(F.lit("acme"), F.col("s_suppkey").cast("string"))
    of = lambda before, after="": F.concat(F.lit(before), n, F.lit(after))
    given = [
        of("https://boards.greenhouse.io/", "/jobs/1"), of("https://boards.greenhouse.io/embed/job_board?for="), of("jobs.lever.co/"), of("https://www.comeet.com/jobs/", "/12.345"),
        of("https://", ".wd3.myworkdayjobs.com/en-US/Careers/job/x"), of("https://", ".taleo.net/careersection/2/jobsearch.ftl"), of("https://www.linkedin.com/company/"), of("  https://", ".example.com/careers "),
        of("https://www.amazon.jobs/en/"), of("javascript:"), "",
    ]
    rows = table(spark, d, "supplier").select("s_suppkey", _by_rest("s_suppkey", given).alias("given")).withColumn("kind", companies.classify_source(F.col("given")))
    return rows.select("s_suppkey", T.source_url(F.col("given")).alias("url"), "kind", companies.source_identifier(F.col("given"), F.col("kind")).alias("identifier"), T.safe_link(F.col("given")).alias("safe"))


@query("""SELECT page_id, list_extract(['lever', 'lever', 'greenhouse', 'workable', 'ashby'], page_id % 6 + 1) AS board_type, concat('acme', page_id) AS identifier, CASE WHEN page_id % 6 = 1 THEN 'jobs.eu.lever.co' END AS host,
  CASE page_id % 6 WHEN 0 THEN concat('https://jobs.lever.co/acme', page_id) WHEN 1 THEN concat('https://jobs.eu.lever.co/acme', page_id) WHEN 2 THEN concat('https://job-boards.greenhouse.io/acme', page_id) WHEN 4 THEN concat('https://jobs.ashbyhq.com/acme', page_id) END AS url
  FROM pages WHERE page_id % 6 <> 5""")
def boards_detected(spark, d):
    """The given pages, five of six with a board's address somewhere in them."""
    n = F.concat(F.lit("acme"), F.col("page_id").cast("string"))
    of = lambda before, after: F.concat(F.lit(before), n, F.lit(after))
    links = [of('<a href="https://jobs.lever.co/', '">'), of('<a href="https://jobs.eu.lever.co/', '/apply">'), of("<script src='https://boards.greenhouse.io/embed/job_board/js?for=", "'>"), of(r'"https:\/\/apply.workable.com\/', r'\/"'), of('<iframe src="https://jobs.ashbyhq.com/', '">'), ""]
    found = companies.detect_boards(table(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), _by_rest("page_id", links)).alias("html")))
    return found.where("rank = 1").select("page_id", "board_type", "identifier", "host", companies.board_url(F.col("board_type"), F.col("identifier"), F.col("host")).alias("url"))

"""Pages, feeds and addresses: what a reader of career sites has to tell apart."""

import json

from pyspark.sql import functions as F

from postlark import schemas
from postlark.functions import classify, vectors
from postlark.functions import text as T
from postlark.operators import companies, profiles
from postlark.sources import boards, pages

LONG = "We build things that many people use each day, and we look for one who likes to do so with us. " * 6


def test_link_titles_and_shapes(spark):
    page = """<ul class="list"><li class="card x"><h3>Backend Developer</h3><a href="/jobs/1#top">View details</a></li><li class="card"><a href="/jobs/2"><h4>Data <b>Engineer</b></h4><span>Full time</span></a></li>
    <li class="card"><a href="mailto:x@y.z">mail</a></li><li class="card"><a href="/cv.pdf" aria-label="CV">  </a></li></ul>"""
    got = [tuple(r)[3:] for r in pages.page_links(spark.createDataFrame([(1, "https://www.acme.com/careers", page)], "page_id long, url string, html string")).orderBy("ordinal").collect()]
    assert [x[1:3] for x in got] == [("https://www.acme.com/jobs/1", "Backend Developer"), ("https://www.acme.com/jobs/2", "Data Engineer"), (None, "mail"), (None, "CV")]
    assert {x[3] for x in got} == {"a.>li.card>ul.list"}


def test_page_details(spark):
    ld = json.dumps([[{"@graph": [{"@type": "JobPosting", "title": "QA Lead", "description": "<p>Test &eacute;</p>", "jobLocation": {"address": {"addressLocality": "Haifa"}}, "datePosted": "2024-01-02"}]}]])
    more = "".join(f"<li><a href='/jobs/{i}'>Senior Developer {i}</a></li>" for i in range(6))
    rows = [
        (1, f"<script type='application/ld+json'>{ld}</script><h1>Careers</h1>"),
        (2, f"<title>Acme - jobs</title><nav>menu</nav><main><h1>Careers</h1><h2>Backend Developer</h2><p>Tel Aviv, Israel</p><p>{LONG}</p><ul>{more}</ul></main><a href='/apply'>Apply</a>"),
        (3, f"<h1>Open positions</h1><ul>{more}</ul>"),
        (4, f"<div><h1>משרות</h1><p>Verification Engineer</p><p>{LONG}</p></div>"),
        (5, None),
    ]
    df = spark.createDataFrame([(i, "https://www.acme.com/jobs", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.page_details(df).collect()}
    assert (got[1]["title"], got[1]["location_text"], got[1]["description"]) == ("QA Lead", "Haifa", "Test é") and got[1]["source_published_at"] is not None
    assert got[2]["title"] == "Backend Developer" and got[2]["location_text"] == "Tel Aviv, Israel" and "Senior Developer" not in got[2]["description"] and "menu" not in got[2]["description"]
    assert got[3]["listing"] and got[3]["description"] is None and not got[2]["listing"]
    assert got[4]["title"] == "Verification Engineer" and got[5]["title"] is None
    listed = {r["page_id"]: r["links"] for r in pages.is_listing_page(df).collect()}
    assert listed == {3: 6}


def test_pick_job_feed(spark):
    jobs = [{"Title": f"{k} Developer", "id": i, "location": {"name": "Haifa"}, "link": f"/j/{i}", "description": "<b>x</b>", "published": "2024-01-02"} for i, k in enumerate(["Backend", "Senior Data", "QA"])]
    menu = [{"title": t} for t in ("Home", "About", "Contact", "Blog")]
    docs = spark.createDataFrame([(1, 0, json.dumps({"menu": menu})), (1, 1, json.dumps({"a": {"b": [{"c": jobs}]}})), (2, 0, json.dumps(menu)), (3, 0, "no json")], "page_id long, document int, body string")
    rows = pages.pick_job_feed(docs)
    got = pages.feed_postings(rows, spark.createDataFrame([(1, "https://acme.com/careers/")], "page_id long, url string")).orderBy("ordinal").collect()
    assert [(r["page_id"], r["external_job_id"], r["title"], r["location_text"], r["source_url"], r["description"]) for r in got] == [(1, str(i), j["Title"], "Haifa", f"https://acme.com/j/{i}", "x") for i, j in enumerate(jobs)]


def test_site_feeds_and_taleo(spark):
    elbit = [{"jobId": 7, "jobTitle": "Dev", "area": "North", "description": "&lt;p&gt;Do&lt;/p&gt;", "requirements": "r", "openDate": "2024-01-02", "updateDate": "2024-01-03"}]
    iai = [{"id": "9", "tl": "Ops", "ct": "", "tp": "full", "dc": "text"}]
    amazon = {"jobs": [{"id_icims": "5", "title": "SDE", "city": "Haifa", "job_path": "/en/jobs/5", "is_intern": True, "description": "d", "preferred_qualifications": "p", "posted_date": "September 17, 2026"}]}
    taleo = {"requisitionList": [{"jobId": "1", "contestNo": "77", "linkedColumn": 2, "locationsColumns": [0], "column": ['["IL-IL-Tel Aviv"]', "Sep 14, 2026", "Engineer"]}]}
    fields = ", ".join(f"'{x}'" for x in ["a"] * 9 + ["Title", "x", "!*!%3Cp%3EText%3C%2Fp%3E", "q", "IL-IL-Lod"])
    page = f"fillList('requisitionDescriptionInterface', 'descRequisition', [{fields}])"
    at = [(1, "site_feed", "https://elbitsystemscareer.com/cron/jobs.json", "listing", json.dumps(elbit)), (2, "site_feed", "https://jobs.iai.co.il/x", "listing", json.dumps(iai)), (3, "site_feed", "https://www.amazon.jobs/en", "listing", json.dumps(amazon))]
    at += [(4, "taleo", "https://acme.taleo.net/careersection/2/jobsearch.ftl", "listing", json.dumps(taleo)), (4, "taleo", "https://acme.taleo.net/careersection/2/jobdetail.ftl?job=77&lang=en", "details", page)]
    p = spark.createDataFrame([(s, t, 1, k, 0, u, None, b) for s, t, u, k, b in at], schemas.PAYLOADS)
    listed = {r["source_id"]: (r["external_job_id"], r["title"], r["location_text"], r["source_url"]) for r in boards.listing_from_payloads(p, ["site_feed", "taleo"]).collect()}
    assert listed == {
        1: ("7", "Dev", "North, Israel", "https://elbitsystemscareer.com/jobs/?jobId=7"), 2: ("9", "Ops", "Israel", "https://jobs.iai.co.il/job/9/"), 3: ("5", "SDE", "Haifa, Israel", "https://www.amazon.jobs/en/jobs/5"),
        4: ("77", "Engineer", "Tel Aviv, IL", "https://acme.taleo.net/careersection/2/jobdetail.ftl?job=77&lang=en"),
    }
    read = {r["source_id"]: r for r in boards.details_from_payloads(p, ["site_feed", "taleo"]).collect()}
    assert read[1]["description"] == "Do" and read[3]["employment_type"] == "internship" and read[3]["description"] == "d\n\nPreferred qualifications\np" and read[3]["source_published_at"] is not None
    assert (read[4]["external_job_id"], read[4]["title"], read[4]["location_text"], read[4]["description"], read[4]["qualifications"]) == ("77", "Title", "Lod, IL", "Text", "q")


def test_boards_in_pages_and_addresses(spark):
    bodies = [
        'x https://www.comeet.com/jobs/acme/17.00A" and https:\\/\\/job-boards.greenhouse.io\\/a\\/jobs', '"company-uid": "F1.008"', "boards.greenhouse.io/embed/job_board?x=1&for=zed'", "//sec.wd3.myworkdayjobs.com/en-US/Site/job/1",
        "https://jobs.lever.co/api/ https://jobs.lever.co/" + "n" * 80 + '"', "apply.workable.com/j/ABC",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "page_id int, html string")
    got = sorted((r["page_id"], r["rank"], r["board_type"], r["identifier"]) for r in companies.detect_boards(df).collect())
    assert got == [(0, 1, "comeet", "17.00A"), (0, 2, "greenhouse", "a"), (1, 1, "comeet", "F1.008"), (2, 1, "greenhouse", "zed"), (3, 1, "workday", "sec/Site"), (4, 1, "lever", "n" * 80)]
    urls = ["https://amazon.jobs/en", "https://sec.wd3.myworkdayjobs.com/he-IL/Unit/page/1", "https://www.comeet.com/jobs/acme/F1.008", "https://boards.greenhouse.io/embed/job_board?for=q"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", companies.classify_source(F.col("u")).alias("t")).withColumn("i", companies.source_identifier(F.col("u"), F.col("t")))
    assert [(r["t"], r["i"]) for r in rows.collect()] == [("site_feed", "amazon"), ("workday", "sec/Unit"), ("comeet", "F1.008"), ("greenhouse", "q")]
    types = spark.createDataFrame([(1, json.dumps({"post": {"rest_base": "posts"}, "career": {"rest_base": "open-jobs"}}))], "page_id int, body string")
    found = companies.wordpress_job_types(spark.createDataFrame([(1, "x /wp-content/ y")], "page_id int, html string"), types, spark.createDataFrame([(1, "open-jobs", 9)], "page_id int, rest_base string, total int"), spark.createDataFrame([(1, 3)], "page_id int, links int"))
    assert [tuple(r) for r in found.collect()] == [(1, "open-jobs")]


def test_years_and_references(spark):
    years = {
        "10 years in a row": None, "Founded 5 years ago in Haifa": None, "5 years left in the program": None, "3+ years of backend experience": 3, "at least 4 years": 4, "1.5 years of work": 2, "2-4 years of Go, 6+ years of C": 6,
        "דרוש ניסיון של 3 שנים": 3, "תואר של 3 שנים": None, "ניסיון של שנתיים": 2,
    }
    asked = {"no experience required": True, "we will not consider people with no experience required": False, "לא יתקבלו מועמדים ללא ניסיון": False, "ללא ניסיון": True, "x" * 60 + " fresh graduates": True}
    signs = {"&#8211;&eacute;&reg;": "–é®", "&amp;lt; &lt;b&gt;": "&lt; <b>", "&#x1F600; &nosuch; &#128; &#0;": "😀 &nosuch; € \ufffd", "a & b": "a & b"}
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string").coalesce(1)
    assert [r[0] for r in rows(years).select(classify.min_years(F.col("x"))).collect()] == list(years.values())
    assert [r[0] for r in rows(asked).select(classify.no_experience_needed(F.col("x"))).collect()] == list(asked.values())
    assert [r[0] for r in rows(signs).select(T.unescape(F.col("x"))).collect()] == list(signs.values())


def test_profiles(spark):
    text = ["Work experience:\nA", "hands-on experience in Python", "ניסיון תעסוקתי"]
    rows = spark.createDataFrame([(i, t, 6.0, None, [] if i == 1 else ["x"], ["go"]) for i, t in enumerate(text)], "id int, text string, years_of_experience double, seniority string, skills array<string>, cloud array<string>")
    got = [(r["years_of_experience"], r["seniority"], r["skills"]) for r in profiles.profile_rules(rows).orderBy("id").collect()]
    assert got == [(6.0, "senior", ["x"]), (0.0, "junior", ["python"]), (6.0, "senior", ["x"])]
    lists = {None: [], '"a "': ["a"], "plain": ["plain"], '["a", {"d": "B.Sc.", "y": "2022"}, " "]': ["a", "B.Sc., 2022"], '{"k": "v"}': ["v"]}
    df = spark.createDataFrame([(x,) for x in lists], "x string").coalesce(1)
    assert [r[0] for r in df.select(profiles.string_list(F.col("x"))).collect()] == list(lists.values())
    old = spark.createDataFrame([(1, "h1", 1, False), (2, "h2", 2, True)], "id long, file_hash string, version int, is_active boolean")
    again = profiles.add_profile(old, spark.createDataFrame([(9, "h1")], "id long, file_hash string"))
    fresh = profiles.add_profile(old, spark.createDataFrame([(9, "h3")], "id long, file_hash string"))
    assert sorted((r["id"], r["version"], r["is_active"]) for r in again.collect()) == [(1, 1, True), (2, 2, False)]
    assert sorted((r["id"], r["version"], r["is_active"]) for r in fresh.collect()) == [(1, 1, False), (2, 2, False), (9, 3, True)]

"""Landed answers of boards, pages, and the stream of snapshots."""

import json

from pyspark.sql import functions as F

from postlark import schemas
from postlark.sources import boards, elements, pages


def payloads(spark, *rows):
    return spark.createDataFrame([(1, t, 1, kind, page, "https://acme.com/jobs", None, body if isinstance(body, str) else json.dumps(body)) for t, kind, page, body in rows], schemas.PAYLOADS)


def test_listings(spark):
    rows = boards.listing_from_payloads(payloads(
        spark,
        ("greenhouse", "listing", 0, {"jobs": [{"id": 12, "title": "Dev", "location": {"name": "Haifa"}, "absolute_url": "https://g/12", "updated_at": "2024-01-01T00:00:00Z"}]}),
        ("lever", "listing", 0, [{"id": "l1", "text": "Ops", "categories": {"location": "Lod"}, "hostedUrl": "https://l/1"}]),
        ("ashby", "listing", 0, {"jobs": [{"id": "a1", "title": "QA", "location": "X", "jobUrl": "u", "publishedAt": "2024-02-01T00:00:00Z"}]}),
        ("smartrecruiters", "listing", 1, {"content": [{"id": "s2", "name": " B ", "location": {"city": "Lod", "country": "il"}}]}),
        ("smartrecruiters", "listing", 0, {"content": [{"id": "s1", "name": "A", "location": {"fullLocation": "Full"}}]}),
        ("workable", "listing", 0, {"jobs": [{"shortcode": "W", "title": "one", "city": "A", "country": "B"}, {"shortcode": "W", "title": "two", "city": "C"}]}),
        ("comeet", "listing", 0, [{"uid": "c1", "name": "N", "location": {"name": "P"}, "url_active_page": "u", "time_updated": "2024-01-01"}]),
        ("workday", "listing", 0, {"jobPostings": [{"title": "T", "externalPath": "/job/Senior-X_R123-1", "locationsText": "2 Locations"}]}),
        ("jsonld", "listing", 0, '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"J","url":"https://j/1","jobLocation":{"address":{"addressLocality":"Haifa","addressCountry":"IL"}}},{"@type":"Thing"}]}</script>'),
        ("wordpress", "listing", 0, [{"id": 1, "link": "https://w/1", "title": {"rendered": "W &amp; P"}, "content": {"rendered": ""}}]),
        ("taleo", "listing", 0, {"requisitionList": [{"jobId": "9", "contestNo": "77", "column": ["Title", '["IL-IL-Tel Aviv"]', "Sep 14, 2026"]}]}),
    )).collect()
    got = {r["external_job_id"]: (r["title"], r["location_text"]) for r in rows}
    assert got.pop(next(k for k in got if len(k) == 32)) == ("W & P", None)
    assert got == {"12": ("Dev", "Haifa"), "l1": ("Ops", "Lod"), "a1": ("QA", "X"), "s1": ("A", "Full"), "s2": ("B", "Lod, il"), "W": ("one", "A, B"), "c1": ("N", "P"), "R123-1": ("T", "2 Locations"), "https://j/1": ("J", "Haifa, IL"), "77": ("Title", "Tel Aviv, IL")}
    order = {r["external_job_id"]: r["ordinal"] for r in rows}
    assert order["s1"] < order["s2"]


def test_details(spark):
    rows = boards.details_from_payloads(payloads(
        spark,
        ("greenhouse", "details", 0, {"id": 12, "title": "Dev", "content": "&lt;p&gt;Hello&lt;/p&gt;", "departments": [{"name": "R&D"}]}),
        ("lever", "details", 0, [{"id": "l1", "text": "Ops", "descriptionPlain": "top", "lists": [{"text": "You", "content": "<li>a</li><li>b</li>"}], "additional": "<p>end</p>", "createdAt": 1700000000000, "categories": {"commitment": "Full-time"}}]),
        ("comeet", "details", 0, [{"uid": "c1", "name": "N", "details": [{"name": "Description", "value": "<p>d</p>"}, {"name": "Requirements", "value": "<p>r</p>"}, {"name": "Perks", "value": "p"}]}]),
        ("workday", "details", 0, {"jobPostingInfo": {"title": "T", "location": "Haifa, Israel", "additionalLocations": ["Berlin"], "externalPath": "/x_R1", "remoteType": "Hybrid Remote"}}),
        ("jsonld", "details", 0, '<script type="application/ld+json">[{"@type":"JobPosting","title":"J","identifier":{"value":"42"},"description":"&lt;p&gt;x&lt;/p&gt;","employmentType":"FULL_TIME","datePosted":"2024-01-10"}]</script>'),
    ))
    got = {r["external_job_id"]: r for r in rows.collect()}
    assert got["12"]["description"] == "Hello" and got["12"]["department"] == "R&D"
    assert got["l1"]["description"] == "top\n\nYou\na\nb\n\nend" and got["l1"]["employment_type"] == "full_time" and str(got["l1"]["source_published_at"]) == "2023-11-14 22:13:20"
    assert got["c1"]["description"] == "d\n\nPerks\np" and got["c1"]["qualifications"] == "r"
    assert got["R1"]["location_text"] == "Haifa, Israel" and got["R1"]["remote_type"] == "remote"
    assert got["42"]["description"] == "x" and got["42"]["employment_type"] == "full_time"


def test_small_parsers(spark):
    df = spark.createDataFrame([("var a=['x','it\\'s','!*!a%20b']",)], "s string")
    parts = df.select(F.transform(boards.js_strings(F.col("s")), boards.decode_field).alias("p")).first()["p"]
    assert parts == ["x", "it's", "a b"]
    long = spark.createDataFrame([("['" + "a\\'b" * 250_000 + "','" + "x" * 1_000_000 + "']",)], "s string")
    assert long.select(F.transform(boards.js_strings(F.col("s")), F.length).alias("n")).first()["n"] == [750_000, 1_000_000]


def test_pages(spark):
    html = '<html><head><title>Careers | Acme</title></head><body><nav><a href="/about">About</a></nav><ul>' + "".join(f'<li><a class="j" href="/jobs/{i}">Software Engineer {i}</a></li>' for i in range(5)) + '</ul><a href="javascript:x">bad link here</a></body></html>'
    p = spark.createDataFrame([(1, "https://www.acme.com/careers/", html), (2, "https://b.com", "<h1>Backend Developer</h1><p>text</p>")], "page_id long, url string, html string")
    links = pages.job_links(p).orderBy("ordinal").collect()
    assert [(r["page_id"], r["url"]) for r in links] == [(1, f"https://www.acme.com/jobs/{i}") for i in range(5)]
    assert [r["page_id"] for r in pages.is_listing_page(p).collect()] == [1]
    assert {r["page_id"]: r["t"] for r in p.select("page_id", pages.page_title(F.col("html")).alias("t")).collect()} == {1: None, 2: "Backend Developer"}
    feed = spark.createDataFrame([(1, '[{"Title":"Dev","ID":"7","Location":"X"},{"name":"QA"}]')], "k long, b string")
    assert [(r["at"], r["title"], r["id"]) for r in pages.feed_rows(feed, "k", "b").orderBy("at").collect()] == [(0, "Dev", "7"), (1, "QA", None)]


def test_page_title_is_its_sql_on_odd_markup(spark, tmp_path):
    import duckdb

    from postlark.plans import catalog

    bodies = [
        "<h1>a &amp;amp; b &quot;c&quot; d&amp</h1>", "<h1>&lt;b&gt; <i>x</i>\u00a0 </h1>", "<h1></h1><h2>Other</h2><title>Head - more | x</title>", "<H1 class='x'>A\n\tB\x0bC</H1 >",
        "<h1>Jobs</h1><title>CAREERS</title>", "<h1>" + "x" * 121 + "</h1><title>é | y</title>", "<h1>open", "", None, "<title>a&nbsp;b - c</title>", "<h1>one</h1><h1>two</h1>", "<h1>\u3000</h1><title> - x</title>",
    ]
    spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r["page_id"]: r["title"] for r in catalog.QUERIES["page_title"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(catalog.SQL["page_title"]).fetchall()) and got[0] == 'a &amp; b &quot;c&quot; d&amp'


def test_page_title_takes_every_step(spark, tmp_path):
    import duckdb

    from postlark.plans import catalog

    og = lambda content: f'<meta content="{content}" property="og:title">'
    cases = [
        ("<h1>Jobs</h1><h2>Backend <b>Developer</b></h2>", "Backend Developer"), ("<h1><span>Data</span> <i>Engineer</i></h1>", "Data Engineer"),
        ("<h2>Careers</h2><h3></h3><h2>" + "x" * 121 + "</h2><h3>Fourth</h3><h2>Fifth</h2>", "Fourth"), ("<h2>jobs</h2>" * 4 + "<h3>Fifth</h3>" + og("Of the graph") + "<title>T</title>", "Of the graph"),
        ("<h1>Careers</h1>" + og(" QA &amp; more\n") + "<title>T | x</title>", "QA & more"), (og("\n") + "<meta property=og:title><title>Ops - Acme | x</title>", "Ops"),
        ("<!-- <h1>no</h1> --><script>'<h1>no</h1>'</script><h1>yes<li>on<li></h1>", "yes on"), ("<ul><li><h1>One<li>Two</ul>", "One"), ("<div><h1>One</div>Two", "One"), ("<h1 title='a>b'>One</h1>", "One"),
        ("<![foo[ z ]]><h1>One</h1>", "One"), ("<h1/><h3 class=a/>Three</h3>", "Three"), ("<h1>1<2 &lt;b>c<!-- --></i>d</>e</h1>", "1<2 <b>c de"), ("<p>text</p>", None),
    ]
    rows = [(i, "u", b) for i, (b, _) in enumerate(cases)] + [(0, "u", "<h1>Again</h1>"), (1, "u", cases[1][0]), (None, "u", "<h3>None's</h3>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(repr((r["page_id"], r["title"])) for r in catalog.QUERIES["page_title"](spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, [(i, t) for i, (_, t) in enumerate(cases)] + [(0, "Again"), (1, "Data Engineer"), (None, "None's")])) == sorted(map(repr, con.sql(catalog.SQL["page_title"]).fetchall()))
    listed = spark.createDataFrame([(0, "From the list"), (13, "Jobs")], "page_id long, title string")
    told = {r["page_id"]: r["title"] for r in pages.page_titles(spark.createDataFrame(rows[:14], "page_id long, url string, html string"), listed).collect()}
    assert (told[0], told[1], told[13]) == ("From the list", "Data Engineer", "Jobs")


def test_partitions_of_pages_follow_their_length(spark, monkeypatch):
    p = spark.createDataFrame([(i, "https://a.com", f"<html><body><article><h1>T {i}</h1><p>{'word ' * 40}</p></article></body></html>" if i else None) for i in range(60)], "page_id long, url string, html string")
    few = {r["page_id"]: r["text"] for r in pages.page_texts(p).collect()}
    heads = sorted(map(repr, pages.page_heads(p).collect()))
    assert elements.part_count(p) is None
    monkeypatch.setattr(elements, "PART_CHARS", 400)
    parts = elements.part_count(p)
    assert 30 < parts < 60 and elements.pieces(p).rdd.getNumPartitions() == parts == pages.page_texts(p).rdd.getNumPartitions()
    assert {r["page_id"]: r["text"] for r in pages.page_texts(p).collect()} == few and sorted(map(repr, pages.page_heads(p).collect())) == heads

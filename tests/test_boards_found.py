"""Boards behind pages, posts without text, later names of signs, candidates' and roles' texts, scores kept up."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postlark.functions import text as T
from postlark.operators import companies, ingest, scoring
from postlark.sources import boards, pages


def test_board_hosts_and_probes(spark):
    rows = {
        1: '<a href="https://jobs.eu.lever.co/acme/">jobs</a>', 2: '<a href="https://jobs.lever.co/beta">jobs</a>', 3: '<div class="comeet-outer-wrapper"><a href="/careers/dev/AB.12C/x">Dev</a></div>',
        4: "<script>window.greenhouse = 1</script>", 5: "<p>nothing here</p>", 6: None,
    }
    df = spark.createDataFrame([(i, f"https://www.site{i}.com/careers", h) for i, h in rows.items()], "page_id long, url string, html string")
    found = companies.detect_boards(df).withColumn("url", companies.board_url(F.col("board_type"), F.col("identifier"), F.col("host"))).collect()
    assert {(r["page_id"], r["board_type"], r["identifier"], r["url"]) for r in found} == {(1, "lever", "acme", "https://jobs.eu.lever.co/acme"), (2, "lever", "beta", "https://jobs.lever.co/beta")}
    probes = companies.board_probes(df)
    assert {(r["page_id"], r["board_type"], r["url"], r["rank"]) for r in probes.collect()} == {(3, "comeet", "https://www.site3.com/careers/dev/AB.12C/x", 1), (4, "greenhouse", "https://job-boards.greenhouse.io/site4", 1)}
    answers = probes.withColumn("body", F.when(F.col("page_id") == 3, F.lit('company_uid = "17.00B"')).otherwise(F.lit("{}")))
    assert {tuple(r) for r in companies.probed(answers).collect()} == {(3, "comeet", "17.00B"), (4, "greenhouse", "site4")}
    assert companies.probed(probes.withColumn("body", F.lit(None).cast("string"))).count() == 0


def test_posts_without_text_read_their_page(spark):
    posts = [{"id": 1, "link": "https://a.com/j/1", "title": {"rendered": "Dev &check;"}, "content": {"rendered": "<p>Text of the post</p>"}}, {"id": 2, "link": "https://a.com/j/2", "title": {"rendered": "Ops"}, "content": {"rendered": ""}}]
    landed = spark.createDataFrame([(1, "wordpress", 1, "listing", 0, "https://a.com", None, json.dumps(posts))], "source_id long, source_type string, crawl_id long, kind string, page_no int, url string, fetched_at timestamp, body string")
    at = F.lit("2024-01-01").cast("timestamp")
    ids = {r["title"]: r["external_job_id"] for r in boards.listing_from_payloads(landed, ["wordpress"]).collect()}
    assert set(ids) == {"Dev ✓", "Ops"}
    html = "<main><h1>{}</h1><p>Haifa, Israel</p><p>What the page says of it</p></main>"
    page = spark.createDataFrame([(k, f"https://a.com/j/{k}", html.format(t), 1, 1, ids[t]) for k, t in ((1, "Dev ✓"), (2, "Ops"))], "page_id long, url string, html string, source_id long, crawl_id long, external_job_id string")
    details = boards.details_from_payloads(landed, ["wordpress"]).unionByName(ingest.page_fallback(pages.page_details(page), page), allowMissingColumns=True)
    got = {r["title"]: (r["description"], r["location_text"]) for r in ingest.read_postings(boards.listing_from_payloads(landed, ["wordpress"]), details, at).collect()}
    assert got["Dev ✓"][0] == "Text of the post" and "What the page says of it" in got["Ops"][0] and got["Ops"][1] == "Haifa, Israel"


def test_later_names(spark):
    signs = {"&check;&approx;&nbsp;x": "✓≈\u00a0x", "&check x &amp y": "&check x & y", "&NotEqualTilde;": "≂̸", "&nosuch;": "&nosuch;"}
    got = spark.createDataFrame([(x,) for x in signs], "x string").coalesce(1).select(T.unescape(F.col("x"))).collect()
    assert [r[0] for r in got] == list(signs.values())


def test_texts_of_roles_and_candidates(spark):
    df = spark.createDataFrame([("Dev", ["Coder", "Programmer"], "writes", ["go", "sql"], ["aws"]), ("Ops", None, None, [], None)], "n string, a array<string>, d string, k array<string>, p array<string>")
    assert [r[0] for r in df.select(scoring.role_text(*map(F.col, "nadkp"))).collect()] == ["Dev\nCoder\nProgrammer\nwrites\nKeywords: go, sql\nPreferred skills: aws", "Ops"]
    c = spark.createDataFrame([(["NodeJS", "Excel"], None, "Worked with Python and k8s")], "s array<string>, l array<string>, t string")
    assert c.select(scoring.candidate_skills([F.col("s"), F.col("l")], F.col("t"))).first()[0] == ["excel", "kubernetes", "node.js", "python"]


def test_scores_kept_up(spark):
    """After any changes the rows are those of a full run, and only what changed is scored."""
    import random

    rng = random.Random(6)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    schema = "id long, title string, department string, qualifications string, normalized_description string, description string, responsibilities string, required_skills array<string>, preferred_skills array<string>, country string, location_text string, remote_type string, embedding array<double>, status string, archived_at timestamp, source_published_at timestamp, first_seen_at timestamp"
    role_schema = "id long, canonical_name string, aliases array<string>, positive_keywords array<string>, negative_keywords array<string>, max_expected_years int, embedding array<double>, enabled boolean"
    import datetime

    day = datetime.datetime(2024, 1, 1)

    def posting(i):
        return [i, rng.choice(["Senior Dev", "Junior Dev", "Ops"]), None, rng.choice(["", "3+ years of Python"]), "Docker and Go developer", None, None, ["python"], [], rng.choice(["Israel", None]), "Haifa", "unknown", vec(), rng.choice(["active", "active", "closed"]), None, None, day - datetime.timedelta(hours=rng.randrange(900))]

    def role(i):
        return [i, rng.choice(["Dev", "Ops"]), ["coder"], ["junior"], [], 2, vec(), True]

    postings, roles = [posting(i) for i in range(30)], [role(i) for i in range(3)]
    candidate = spark.createDataFrame([(1, ["python", "docker"], vec())], "candidate_id long, skills array<string>, embedding array<double>")
    frames = lambda: (spark.createDataFrame(postings, schema), spark.createDataFrame(roles, role_schema))
    w = scoring.Weights(judgement=0.25)
    judged = spark.createDataFrame([(1, k % 3, k, k / 30) for k in range(0, 30, 2)], "candidate_profile_id long, target_role_id long, job_id long, probability double")
    at = lambda d: F.lit(str(day + datetime.timedelta(days=d))).cast("timestamp")
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.select(*scoring.MATCH_COLUMNS).collect())
    old = scoring.score_pairs(*frames(), candidate, at(0), w, judged, keys=True)
    old = spark.createDataFrame(old.collect(), old.schema)
    for k in (3, 4, 5):
        postings[k] = posting(k)
    postings.append(posting(40))
    del postings[10]
    roles[1] = role(1)
    roles.append(role(9))
    full = plain(scoring.score_pairs(*frames(), candidate, at(0), w, judged, keys=True))
    assert plain(scoring.maintained_scores(old, *frames(), candidate, at(0), w, judged)) == full
    new, gone = scoring.rescored(old, *frames(), candidate, at(0), w)
    open_ = [p for p in postings if p[13] == "active"]
    fresh = [p[0] for p in open_ if p[0] in (3, 4, 5, 40)]
    assert new.count() <= len(fresh) * 4 + (len(open_) - len(fresh)) * 2 and gone.count() < old.count() / 2
    # A later day changes the postings that pass a step of age, and those alone.
    later = plain(scoring.score_pairs(*frames(), candidate, at(1), w, judged, keys=True))
    assert plain(scoring.maintained_scores(old, *frames(), candidate, at(1), w, judged)) == later
    again = scoring.with_judgement(old, judged, w)
    assert plain(again) == plain(old)


def test_scores_kept_up_read_each_posting_once(spark, monkeypatch):
    """Changed postings and changed roles are one pass: the skills of a posting are read by one step of the plan beside the stored scores."""
    posting = "id long, title string, department string, qualifications string, normalized_description string, description string, responsibilities string, required_skills array<string>, preferred_skills array<string>, country string, location_text string, remote_type string, embedding array<double>, status string, archived_at timestamp, source_published_at timestamp, first_seen_at timestamp"
    role = "id long, canonical_name string, aliases array<string>, positive_keywords array<string>, negative_keywords array<string>, max_expected_years int, embedding array<double>, enabled boolean"
    rows = [(i, "Dev", None, None, None, "Go", None, ["go"], [], None, None, "unknown", [1.0, i + 0.5], "active", None, None, None) for i in range(6)]
    roles = [(i, "Dev", [], [], [], 2, [i + 1.0, 1.0], True) for i in range(2)]
    candidate = spark.createDataFrame([(1, ["go"], [1.0, 1.0])], "candidate_id long, skills array<string>, embedding array<double>")
    day = F.lit("2024-01-01").cast("timestamp")
    frames = lambda p, r: (spark.createDataFrame(p, posting), spark.createDataFrame(r, role))
    old = scoring.score_pairs(*frames(rows[:4], roles), candidate, day, keys=True)
    old = spark.createDataFrame(old.collect(), old.schema)
    keys = lambda df: sorted((r["job_id"], r["target_role_id"]) for r in df.collect())
    # Without a new role only new postings are due; with one, every posting for it, and new ones for all.
    for now, due in ((roles, [(i, k) for i in (4, 5) for k in (0, 1)]), ([*roles, (7, *roles[0][1:])], [(i, k) for i in range(6) for k in (0, 1, 7) if i > 3 or k == 7])):
        assert keys(scoring.rescored(old, *frames(rows, now), candidate, day)[0]) == due
        got = scoring.maintained_scores(old, *frames(rows, now), candidate, day)
        assert keys(got) == [(i, r[0]) for i in range(6) for r in now]
        assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    # More roles than are sent to every task: pair by pair, with the same rows.
    plain = lambda: sorted(tuple(map(str, r)) for r in scoring.maintained_scores(old, *frames(rows, now), candidate, day).select(*scoring.MATCH_COLUMNS).collect())
    sent = plain()
    monkeypatch.setattr(scoring, "MOST_ROLES", 1)
    assert plain() == sent

"""Crawls, companies, retention and reports as sequences of small tables."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from postlark import schemas
from postlark.operators import companies, crawl, reports, retention, scoring, search

STORED = "source_id long, external_job_id string, title string, content_hash string, status string, missing_streak int, first_seen_at timestamp, last_seen_at timestamp, archived_at timestamp"
LISTED = "source_id long, crawl_id long, ordinal long, external_job_id string, title string, content_hash string, fetch_error string, unavailable boolean"
RUNS = "source_id long, crawl_id long, listing_error string"


def at(text):
    return F.lit(text).cast("timestamp")


def step(spark, stored, listed, runs, now="2024-01-02 00:00:00"):
    old = stored if not isinstance(stored, list) else spark.createDataFrame([], STORED)
    after, counts = crawl.apply_crawl(spark.createDataFrame(listed, LISTED), old, spark.createDataFrame(runs, RUNS), at(now))
    return after.cache(), counts.collect()


def state(df):
    return {r["external_job_id"]: (r["status"], r["missing_streak"], r["action"]) for r in df.collect()}


def test_crawl_life(spark):
    row = lambda i, h="h", e=None, u=False, o=0: (1, 1, o, i, i, h, e, u)
    run = [(1, 1, None)]
    a, c = step(spark, [], [row("a"), row("b"), row("a", "other", o=1)], run)
    assert state(a) == {"a": ("active", 0, "created"), "b": ("active", 0, "created")} and c[0]["jobs_seen"] == 2 and c[0]["jobs_created"] == 2
    b, c = step(spark, a.drop("action"), [row("a", "new")], run)
    assert state(b) == {"a": ("active", 0, "updated"), "b": ("active", 1, "missing")} and c[0]["jobs_updated"] == 1
    again, c = step(spark, b.drop("action"), [row("a", None, "boom")], run)  # all that was read failed: nothing closes
    assert state(again) == {"a": ("active", 0, "failed_seen"), "b": ("active", 1, "untouched")} and c[0]["error_type"] == "AllJobsFailed"
    d, _ = step(spark, b.drop("action"), [row("a", "new")], run)
    e, c = step(spark, d.drop("action"), [row("a", "new")], run)
    assert state(e) == {"a": ("active", 0, "seen"), "b": ("closed", 3, "missing_closed")} and c[0]["jobs_closed"] == 1
    f, _ = step(spark, e.drop("action"), [row("a", None, None, True), row("b", "h"), row("z", None, None, True)], run)
    assert state(f) == {"a": ("closed", 0, "closed"), "b": ("active", 0, "seen")}
    g, c = step(spark, f.drop("action"), [], [(1, 1, "HTTP 500")])
    assert {k: v[:2] for k, v in state(g).items()} == {k: v[:2] for k, v in state(f).items()} and c[0]["run_status"] == "failed"
    schemas.assert_unique(g, ["source_id", "external_job_id"])
    with pytest.raises(ValueError):
        schemas.assert_unique(g.union(g), ["source_id", "external_job_id"])


def test_same_snapshot_again_changes_nothing(spark):
    row = [(1, 1, 0, "a", "a", "h", None, False)]
    a, _ = step(spark, [], row, [(1, 1, None)])
    b, _ = step(spark, a.drop("action"), row, [(1, 1, None)], "2024-01-03 00:00:00")
    keep = [c for c in a.columns if c not in ("last_seen_at", "action")]
    assert a.select(keep).collect() == b.select(keep).collect()


def test_needs_fetch(spark):
    rows = [("2024-01-02", "2024-01-01", "2024-01-01", None, "closed", True), ("2024-01-01", "2024-01-01", None, None, "active", False), (None, None, None, None, "active", True), (None, None, "2024-01-01", None, "closed", True),
            (None, "2024-01-01", "2024-01-01", "2024-01-01", "active", False), (None, None, "2024-01-09 13:00:00", None, "active", False), (None, None, "2024-01-09 11:00:00", None, "active", True)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, s string, want boolean")
    t = lambda c: F.col(c).cast("timestamp")
    got = df.select(crawl.needs_fetch(t("a"), t("b"), t("c"), t("d"), F.col("s"), at("2024-01-10 12:00:00")).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_schedule_and_due(spark):
    o = spark.createDataFrame([(1, True, 5, 3), (2, False, 5, 0), (3, False, 60, 9)], "source_id long, ok boolean, poll_minutes int, consecutive_failures int")
    got = {r["source_id"]: (r["consecutive_failures"], r["wait_minutes"]) for r in crawl.schedule_next(o, at("2024-01-01")).collect()}
    assert got == {1: (0, 5.0), 2: (1, 10.0), 3: (10, 1440.0)}
    s = spark.createDataFrame([(1, 1, "generic_html", True, None), (2, 1, "lever", True, "2024-01-01"), (3, 1, "lever", True, "2025-01-01"), (4, 2, "lever", True, None), (5, 1, "unsupported", True, None), (6, 1, "ashby", True, None)], "id long, company_id long, source_type string, enabled boolean, next_check_at string")
    c = spark.createDataFrame([(1, True), (2, False)], "id long, enabled boolean")
    assert [r["id"] for r in crawl.due_sources(s.withColumn("next_check_at", F.col("next_check_at").cast("timestamp")), c, at("2024-06-01")).collect()] == [6, 2, 1]


def test_companies(spark):
    raw = spark.createDataFrame([(0, "Company", "URL"), (1, " Acme ", "http://a"), (2, "", ""), (3, "acme", "http://b"), (4, "New", None)], "ordinal int, name string, url string")
    old = spark.createDataFrame([("acme", "Acme", "http://a", False), ("gone", "Gone", None, True), ("off", "Off", None, False)], "normalized_name string, name string, original_sheet_url string, enabled boolean")
    got = {r["normalized_name"]: (r["action"], r["enabled"], r["url"]) for r in companies.sync_companies(companies.company_rows(raw), old).collect()}
    assert got == {"acme": ("updated", True, "http://b"), "new": ("created", True, None), "gone": ("disabled", False, None), "off": ("absent", False, None)}
    urls = ["https://boards.greenhouse.io/acme", "jobs.lever.co/foo/1", "https://x.wd3.myworkdayjobs.com/en-US/Careers", "https://linkedin.com/a", "https://notlever.co", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("k", companies.classify_source(F.col("u")))
    got = df.select("k", companies.source_identifier(F.col("u"), F.col("k")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("greenhouse", "acme"), ("lever", "foo"), ("workday", "x/Careers"), ("unsupported", None), ("generic_html", None), ("unsupported", None)]
    page = spark.createDataFrame([(1, '<a href="https:\\/\\/jobs.lever.co\\/beta"></a><script src="https://boards.greenhouse.io/embed/job_board/js?for=beta1">')], "page_id long, html string")
    assert [(r["board_type"], r["identifier"]) for r in companies.detect_boards(page).orderBy("rank").collect()] == [("greenhouse", "beta1"), ("lever", "beta")]


def test_retention(spark):
    p = spark.createDataFrame([(1, "active", "2024-01-01", "x"), (2, "closed", "2024-01-01", "x"), (3, "active", "2024-02-01", "x"), (4, "closed", "2024-01-01", "x")], "id long, status string, t string, description string")
    p = p.select("id", "status", F.col("t").cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("source_published_at"), F.lit(None).cast("timestamp").alias("archived_at"), "description")
    jobs = lambda *x: spark.createDataFrame([(i,) for i in x], "job_id long")
    left, matches, n = retention.prune(p, jobs(1, 2, 3, 4), jobs(4), jobs(), at("2024-02-05"))
    assert {r["id"]: (r["description"], r["archived_at"] is not None) for r in left.collect()} == {1: (None, True), 3: ("x", False), 4: ("x", False)}
    assert sorted(r["job_id"] for r in matches.collect()) == [3, 4] and tuple(n.first()) == (1, 1)


def test_pairwise_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9) / 2.0, rng.random() < 0.4) for _ in range(200)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in product(pos, neg)) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, p boolean")
    assert reports.pairwise_accuracy(df, "s", "p").first()["accuracy"] == pytest.approx(want)
    assert reports.pairwise_accuracy(df.where("p"), "s", "p").first()["accuracy"] is None


def test_feedback_and_applications(spark):
    f = spark.createDataFrame([(1, 7, "saved", "2024-01-01")], "id long, job_id long, action string, created_at string")
    apps = spark.createDataFrame([(8, "offer", "t", "t", None)], "job_id long, status string, applied_at string, updated_at string, notes string")
    new = spark.createDataFrame([(2, 7, "applied", "2024-01-02"), (3, 8, "applied", "2024-01-02"), (4, 7, "applied", "2024-01-03")], f.schema)
    feedback, opened = reports.append_feedback(f, apps, new)
    assert feedback.count() == 4 and {r["job_id"]: (r["status"], r["applied_at"]) for r in opened.collect()} == {7: ("applied", "2024-01-02"), 8: ("offer", "t")}
    patch = spark.createDataFrame([(8, None, " ", False)], "job_id long, new_status string, new_notes string, clear_notes boolean")
    assert reports.update_applications(apps.withColumn("updated_at", at("2024-01-01")), patch, at("2024-01-05")).first()["status"] == "offer"


def test_filters_and_upsert(spark):
    assert search.hidden_fits("not_experienced", "senior dev") == {"student"} and search.search_words("jobs in Tel Aviv") == ["jobs", "tel", "aviv"] and search.search_words("the") == ["the"]
    with pytest.raises(ValueError):
        scoring.Weights(level=0.9)
    old = spark.createDataFrame([(1, 1, 1, 5.0, "f"), (1, 1, 2, 5.0, "g")], "candidate_profile_id long, target_role_id long, job_id long, final_score double, fit string")
    new = spark.createDataFrame([(1, 1, 2, 9.0), (1, 1, 3, 7.0)], "candidate_profile_id long, target_role_id long, job_id long, final_score double")
    got = scoring.upsert_matches(old, new)
    assert {r["job_id"]: (r["final_score"], r["fit"]) for r in got.collect()} == {1: (5.0, "f"), 2: (9.0, "g"), 3: (7.0, None)}
    schemas.assert_unique(got, schemas.KEYS["matches"])

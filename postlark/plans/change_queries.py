"""Registered queries of changes: rows that are appended, patched, repointed, found due."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import companies, crawl, ingest, profiles, reports, scoring
from ..operators.tables import shared_folder
from .registry import AS_OF, at, query
from .views import table, view


@query(f"""WITH apps AS (SELECT DISTINCT job_id, 'saved' AS status, TIMESTAMP '2023-12-01 00:00:00' AS applied_at FROM v_feedback WHERE job_id % 3 = 0),
  opened AS (SELECT job_id, 'applied' AS status, min(created_at) AS applied_at FROM v_feedback WHERE id % 10 = 0 AND action = 'applied' AND job_id NOT IN (SELECT job_id FROM apps) GROUP BY job_id),
  every AS (SELECT * FROM apps UNION ALL SELECT * FROM opened)
  SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'interview' ELSE status END AS status, applied_at, CASE WHEN job_id % 5 = 0 THEN TIMESTAMP '{AS_OF}' ELSE applied_at END AS updated_at,
    CASE WHEN job_id % 5 = 0 AND job_id % 2 = 0 THEN NULL WHEN job_id % 5 = 0 THEN 'called' WHEN status = 'saved' THEN 'kept' END AS notes FROM every""")
def applications_changed(spark, d):
    """Applications after new feedback opened some and a patch went over every fifth: half of these lose their notes."""
    f = view(spark, d, "v_feedback")
    first = F.lit("2023-12-01 00:00:00").cast("timestamp")
    apps = f.where("job_id % 3 = 0").select("job_id").distinct().select("job_id", F.lit("saved").alias("status"), first.alias("applied_at"), first.alias("updated_at"), F.lit("kept").alias("notes"))
    _, apps = reports.append_feedback(f.where("id % 10 <> 0"), apps, f.where("id % 10 = 0"))
    patch = f.where("job_id % 5 = 0").select("job_id").distinct().select("job_id", F.lit("interview").alias("new_status"), F.lit(" called ").alias("new_notes"), (F.col("job_id") % 2 == 0).alias("clear_notes"))
    return reports.update_applications(apps, patch, at())


@query(f"SELECT source_id, run_id AS crawl_id, status AS run_status, error_type, jobs_seen, TIMESTAMP '{AS_OF}' AS started_at FROM v_runs")
def runs_appended(spark, d):
    """Counts of crawls added to the table of runs twice, as after two batches."""
    runs = view(spark, d, "v_runs").select("source_id", F.col("run_id").alias("crawl_id"), F.col("status").alias("run_status"), "error_type", "jobs_seen")
    folder = shared_folder(spark, "runs")
    for part in ("run_status = 'success'", "run_status <> 'success'"):
        crawl.append_runs(runs.where(part), at(), folder)
    return spark.read.parquet(folder)


@query("""SELECT id, CASE WHEN m THEN 'ashby' ELSE source_type END AS source_type, CASE WHEN m THEN concat('b', id) ELSE external_identifier END AS external_identifier, CASE WHEN m THEN concat('https://jobs.ashbyhq.com/b', id) ELSE source_url END AS source_url,
  CAST(CASE WHEN m THEN 3 ELSE poll_interval_minutes END AS INT) AS poll_interval_minutes, CASE WHEN NOT m THEN next_check_at END AS next_check_at FROM (SELECT *, source_type = 'generic_html' AS m FROM v_sources)""")
def sources_repointed(spark, d):
    """Plain pages that turned out to front a board are crawled there from now on."""
    s = view(spark, d, "v_sources")
    name = F.concat(F.lit("b"), F.col("id").cast("string"))
    found = s.where("source_type = 'generic_html'").select(F.col("id").alias("source_id"), F.lit("ashby").alias("board_type"), name.alias("identifier"), companies.board_url(F.lit("ashby"), name, F.lit(None)).alias("url"))
    return crawl.repoint_sources(s, found).select("id", "source_type", "external_identifier", "source_url", "poll_interval_minutes", "next_check_at")


@query("""SELECT c_custkey AS id, c_custkey AS version, c_custkey = 5 AS is_active FROM customer UNION ALL SELECT max(c_custkey) + 1, max(c_custkey) + 1, false FROM customer""")
def profiles_added(spark, d):
    """A new file makes the next version; then a known file comes in again, and its profile is the one that is active."""
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("file_hash"), F.col("c_custkey").alias("version"), (F.col("c_custkey") == 3).alias("is_active"))
    new = c.agg((F.max("c_custkey") + 1).alias("id"), F.sha2(F.lit("new"), 256).alias("file_hash"))
    again = old.where("id = 5").select((F.col("id") - 100).alias("id"), "file_hash")
    return profiles.add_profile(profiles.add_profile(old, new), again).select("id", "version", "is_active")


@query("""WITH a AS (SELECT *, CAST(id % 8 + 1 AS INT) AS n FROM v_postings) SELECT id, CASE WHEN status <> 'active' THEN seniority WHEN id % 3 = 2 THEN 'unknown' WHEN n >= 5 THEN 'senior' WHEN n <= 2 THEN 'junior' ELSE 'mid' END AS seniority,
  CAST(CASE WHEN status <> 'active' THEN experience_min_years WHEN id % 3 <> 2 THEN n END AS INT) AS experience_min_years FROM a""")
def levels_reassessed(spark, d):
    """Open postings read anew: the years stand in what is asked for, else in the text, else nowhere."""
    said = F.concat(F.lit("at least "), (F.col("id") % 8 + 1).cast("string"), F.lit(" years of experience"))
    p = view(spark, d, "v_postings").withColumns({"qualifications": F.when(F.col("id") % 3 == 0, said).otherwise(" "), "normalized_description": F.when(F.col("id") % 3 == 1, said)})
    return ingest.reassess_seniority(p)[0].select("id", "seniority", "experience_min_years")


@query("SELECT id FROM v_postings WHERE id % 3 <> 0")
def readings_due(spark, d):
    """Postings without a reading, or with one of another text."""
    hashed = view(spark, d, "v_postings").withColumn("content_hash", F.sha2("title", 256))
    of = F.when(F.col("id") % 3 == 0, F.col("content_hash")).when(F.col("id") % 3 == 1, "old")
    return ingest.needs_reading(hashed.withColumn("reading", F.when(of.isNotNull(), F.struct(of.alias("content_hash"))))).select("id")


@query("SELECT m.job_id, m.target_role_id FROM v_matches m JOIN v_postings p ON p.id = m.job_id WHERE p.status = 'active' AND m.skill_score >= 0.5 AND m.job_id % 2 = 1")
def judgements_due(spark, d):
    """Matches close enough to their role that were judged on another text, or never."""
    p = view(spark, d, "v_postings").withColumn("content_hash", F.sha2("title", 256))
    m = view(spark, d, "v_matches").withColumn("role_score", F.col("skill_score"))
    judged = m.join(p.select(F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, F.col("content_hash")).when(F.col("id") % 4 == 1, "old").alias("of")), "job_id", "left")
    judged = judged.withColumn("fit", F.when(F.col("of").isNotNull(), F.struct(F.col("of").alias("content_hash"), F.lit(0.5).alias("would_be_considered"))))
    return scoring.needs_judgement(judged, p).select("job_id", "target_role_id")


@query("SELECT DISTINCT concat(user_id, ':', event_type) AS dedup_key FROM events WHERE concat(user_id, ':', event_type) NOT IN (SELECT concat(user_id, ':', event_type) FROM events WHERE event_id % 50 = 0)")
def notices_due(spark, d):
    """One notice for each job and channel that none was sent for."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("channel"))
    sent = e.where("event_id % 50 = 0").select(reports.notification_key().alias("dedup_key"))
    return reports.notifications_due(e, sent).select("dedup_key")


@query("""SELECT count(*) FILTER (id % 4 <> 0) + count(*) FILTER (id % 10 = 1) AS companies_seen, count(*) FILTER (id % 10 = 1) AS companies_created, count(*) FILTER (id % 4 <> 0 AND NOT enabled) AS companies_updated,
  count(*) FILTER (id % 4 = 0 AND enabled) AS companies_disabled, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS sources_created FROM v_companies""")
def sheet_synced(spark, d):
    """A sheet with headings and blank rows, written as CSV and read back: most of the known companies and some new ones."""
    c, folder = view(spark, d, "v_companies"), shared_folder(spark, "sheet")
    known = c.where("id % 4 <> 0").select(F.concat(F.lit(" "), "name").alias("name"), F.col("original_sheet_url").alias("url"))
    new = c.where("id % 10 = 1").select(F.concat(F.lit("New "), "name").alias("name"), F.lit("https://new.example").alias("url"))
    other = c.where("id % 100 = 2").select(F.explode(F.array(F.lit("Company"), F.lit(""), F.lit("חברה"))).alias("name"), F.lit("").alias("url"))
    known.unionByName(new).unionByName(other).write.csv(folder)
    found = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")).alias("source_id"))
    return companies.sync_counters(companies.sync_companies(companies.read_company_rows(spark, folder), c), found)

"""Snapshots of boards against stored postings: new, seen, changed, missing, closed; and when to look next.

Every transition is set-based: one full outer join per batch over all sources. as_of is an argument, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_THRESHOLD, REFRESH_HOURS, MOST_MINUTES = 3, 24, 1440
# Minutes between visits by type of source; others take the default.
POLL_MINUTES = {
    "greenhouse": 3, "lever": 3, "ashby": 3, "smartrecruiters": 3, "workable": 3, "comeet": 3, "workday": 10, "taleo": 10, "site_feed": 3, "wordpress": 3,
    "jsonld": 15, "generic_html": 10, "playwright": 60,
}
#: Types that are slow to read come after the others.
SLOW_TYPES = ("generic_html", "playwright")


def first_of_each_id(listing: DataFrame) -> DataFrame:
    """Of each source's crawl the first row of every id, in listing order."""
    first = Window.partitionBy("source_id", "crawl_id", "external_job_id").orderBy("ordinal")
    return listing.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def needs_fetch(stub_updated: Column, stored_updated: Column, fetched_at: Column, archived_at: Column, status: Column, as_of: Column) -> Column:
    """Whether a listed posting has to be read again; the first rule that applies decides."""
    return (
        F.when(stub_updated.isNotNull() & stored_updated.isNotNull(), stub_updated > stored_updated)
        .when((status == "closed") | fetched_at.isNull(), True)
        .when(archived_at.isNotNull(), stub_updated.isNotNull())
        .otherwise(as_of >= fetched_at + F.make_dt_interval(F.lit(0), F.lit(REFRESH_HOURS)))
    )


def hash_gate(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose content hash is not the stored one's, or whose stored row is archived: only they are embedded again."""
    o = old.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("content_hash").alias("__hash"), F.col("archived_at").alias("__archived"))
    both = new.join(o, [new[k] == o[f"__{k}"] for k in keys], "left")
    return both.where(~F.col("content_hash").eqNullSafe(F.col("__hash")) | F.col("__archived").isNotNull()).select(*new.columns)


def snapshot_diff(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed and stored postings side by side: listed, known and the columns of both (stored ones with s_ before them)."""
    ours = stored.select(*(F.col(c).alias(f"s_{c}") for c in stored.columns), F.lit(True).alias("__known"))
    theirs = first_of_each_id(listing).withColumn("__listed", F.lit(True))
    both = theirs.join(ours, (F.col("source_id") == F.col("s_source_id")) & (F.col("external_job_id") == F.col("s_external_job_id")), "full")
    return both.withColumns({"listed": F.coalesce("__listed", F.lit(False)), "known": F.coalesce("__known", F.lit(False))}).drop("__listed", "__known")


def apply_crawl(listing: DataFrame, stored: DataFrame, runs: DataFrame, as_of: Column, threshold: int = MISSING_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The postings after a crawl of some sources, and a count for each run.

    listing: source_id, crawl_id, ordinal, external_job_id, title, content_hash, fetch_error, unavailable
    stored: source_id, external_job_id, title, content_hash, status, missing_streak, first_seen_at, last_seen_at, archived_at
    runs: source_id, crawl_id, listing_error, and at where the time differs by run. Sources without a run stay as they are.
    Any other columns that listing and stored share are what was read of a posting: each reading replaces them, and one
    with another content hash, or of an archived posting, is an update.

    A listing that failed, or one all of whose pages failed, closes nothing.
    """
    diff = snapshot_diff(listing, stored).withColumn("__source", F.coalesce("source_id", "s_source_id"))
    own_time = "at" in runs.columns
    r = runs.select(F.col("source_id").alias("__run_source"), F.col("crawl_id").alias("run_id"), "listing_error", *([F.col("at").alias("__run_at")] if own_time else []))
    as_of = F.coalesce("__run_at", as_of) if own_time else as_of
    d = diff.join(r, F.col("__source") == F.col("__run_source"), "left")
    fetched, failed = F.col("content_hash").isNotNull(), F.col("fetch_error").isNotNull()
    gone = F.coalesce("unavailable", F.lit(False))
    changed = ~F.col("content_hash").eqNullSafe(F.col("s_content_hash")) | F.col("s_archived_at").isNotNull()
    action = (
        F.when(F.col("run_id").isNull() | F.col("listing_error").isNotNull(), "untouched")
        .when(F.col("listed") & gone & F.col("known"), "closed").when(F.col("listed") & gone, "skipped")
        .when(F.col("listed") & failed & F.col("known"), "failed_seen").when(F.col("listed") & failed, "failed_new")
        .when(F.col("listed") & ~F.col("known") & fetched, "created").when(F.col("listed") & ~F.col("known"), "skipped")
        .when(F.col("listed") & fetched & changed, "updated").when(F.col("listed"), "seen")
        .when(F.col("s_status") == "closed", "still_closed")
        .when(F.col("s_missing_streak") + 1 >= threshold, "missing_closed").otherwise("missing")
    )
    d = d.withColumn("action", action)
    # Two steps: whether a run may close postings is known only when all of its rows are.
    per = d.where(F.col("run_id").isNotNull()).groupBy(F.col("__source").alias("source_id"), F.col("run_id").alias("crawl_id")).agg(
        F.count_if("listed").alias("jobs_seen"), F.count_if(F.col("action") == "created").alias("jobs_created"), F.count_if(F.col("action") == "updated").alias("jobs_updated"),
        F.count_if(F.col("action") == "closed").alias("page_closed"), F.count_if(F.col("action") == "missing_closed").alias("missing_closed"),
        F.count_if(failed).alias("jobs_failed"), F.count_if(fetched | failed | gone).alias("attempted"), F.max("listing_error").alias("listing_error"),
    )
    all_failed = (F.col("attempted") > 0) & (F.col("jobs_failed") == F.col("attempted"))
    error = F.coalesce("listing_error", F.when(all_failed, "AllJobsFailed"))
    outcome = per.withColumn("error_type", error).withColumn("run_status", F.when(error.isNull(), "success").otherwise("failed"))
    ok = outcome.select(F.col("source_id").alias("__ok_source"), (F.col("run_status") == "success").alias("may_close"))
    d = d.join(ok, F.col("__source") == F.col("__ok_source"), "left")
    act = F.when(F.col("action").isin("missing", "missing_closed") & ~F.coalesce("may_close", F.lit(False)), "untouched").otherwise(F.col("action"))
    d = d.withColumn("action", act)
    here = F.col("action").isin("created", "updated", "seen", "failed_seen")
    taken = F.col("action").isin("created", "updated") | (F.col("action") == "seen") & fetched
    known = {"source_id", "crawl_id", "ordinal", "external_job_id", "title", "content_hash", "fetch_error", "unavailable", "status", "missing_streak", "first_seen_at", "last_seen_at", "archived_at", "action"}
    read = [c for c in stored.columns if c in listing.columns and c not in known]
    after = d.where(~F.col("action").isin("skipped", "failed_new")).select(
        F.col("__source").alias("source_id"),
        F.coalesce("external_job_id", "s_external_job_id").alias("external_job_id"),
        F.when(taken, F.col("title")).otherwise(F.col("s_title")).alias("title"),
        F.when(taken, F.col("content_hash")).otherwise(F.col("s_content_hash")).alias("content_hash"),
        F.when(here, "active").when(F.col("action").isin("closed", "missing_closed"), "closed").otherwise(F.col("s_status")).alias("status"),
        F.when(here, 0).when(F.col("action").isin("missing", "missing_closed"), F.col("s_missing_streak") + 1).otherwise(F.col("s_missing_streak")).cast("int").alias("missing_streak"),
        F.coalesce("s_first_seen_at", as_of).alias("first_seen_at"),
        F.when(here | (F.col("action") == "closed"), as_of).otherwise(F.col("s_last_seen_at")).alias("last_seen_at"),
        F.when(~taken, F.col("s_archived_at")).alias("archived_at"),
        *(F.when(taken, F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) for c in read),
        "action",
    )
    closed = F.col("page_closed") + F.when(F.col("run_status") == "success", F.col("missing_closed")).otherwise(0)
    counts = outcome.select("source_id", "crawl_id", "run_status", "error_type", "jobs_seen", "jobs_created", "jobs_updated", closed.alias("jobs_closed"), "jobs_failed")
    return after, counts


def append_runs(counts: DataFrame, as_of: Column, path: str) -> None:
    """Adds the counts of apply_crawl to the table of runs, with the time of the crawl."""
    counts.withColumn("started_at", as_of).write.mode("append").parquet(path)


def numbered_crawls(crawls: DataFrame) -> DataFrame:
    """source_id, crawl_no and n, the crawl's number among its source's."""
    return crawls.select("source_id", "crawl_no").distinct().withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("crawl_no")))


def streak_islands(snapshots: DataFrame, crawls: DataFrame) -> DataFrame:
    """How a posting was listed and missed since it first was, a row for each change: source_id, external_job_id, first, last (numbers of crawls), missing.

    In a row without missing every crawl listed the posting; in one with it none did, and the k-th is a streak of k.
    snapshots: source_id, external_job_id, crawl_no; crawls: source_id, crawl_no.
    """
    numbered = numbered_crawls(crawls)
    end = numbered.groupBy("source_id").agg(F.max("n").alias("end"))
    seen = snapshots.select("source_id", "external_job_id", "crawl_no").distinct().join(numbered, ["source_id", "crawl_no"]).drop("crawl_no")
    posting = Window.partitionBy("source_id", "external_job_id")
    # Crawls that follow each other keep their distance from their place among the posting's.
    runs = seen.withColumn("run", F.col("n") - F.row_number().over(posting.orderBy("n"))).groupBy("source_id", "external_job_id", "run").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    after = F.coalesce(F.lead("first").over(posting.orderBy("first")) - 1, F.col("end"))
    both = runs.join(end, "source_id").withColumn("until", after)
    listed = F.struct(F.col("first").alias("first"), F.col("last").alias("last"), F.lit(False).alias("missing"))
    missed = F.when(F.col("until") > F.col("last"), F.struct((F.col("last") + 1).alias("first"), F.col("until").alias("last"), F.lit(True).alias("missing")))
    return both.select("source_id", "external_job_id", F.inline(F.array_compact(F.array(listed, missed))))


def streak_at(islands: DataFrame, at: DataFrame) -> DataFrame:
    """source_id, external_job_id, n, missing_streak of every posting known at some crawls (at: source_id, n)."""
    rows = islands.join(at.select("source_id", "n"), "source_id").where(F.col("n").between(F.col("first"), F.col("last")))
    return rows.select("source_id", "external_job_id", "n", F.when(F.col("missing"), F.col("n") - F.col("first") + 1).otherwise(0).cast("long").alias("missing_streak"))


def missing_streaks(snapshots: DataFrame, crawls: DataFrame) -> DataFrame:
    """For every posting and crawl since it was first listed, how many crawls in a row have missed it: the islands, a row for each of their crawls."""
    every = streak_islands(snapshots, crawls).withColumn("n", F.explode(F.sequence("first", "last")))
    streak = F.when(F.col("missing"), F.col("n") - F.col("first") + 1).otherwise(0).cast("long")
    return every.join(numbered_crawls(crawls), ["source_id", "n"]).select("source_id", "external_job_id", "crawl_no", streak.alias("missing_streak"))


def empty_streak(runs: DataFrame) -> DataFrame:
    """Successful runs that saw nothing, as did the two successful ones before them."""
    three = Window.partitionBy("source_id").orderBy("started_at", "run_id").rowsBetween(-2, 0)
    good = runs.where("status = 'success'").withColumns({"__seen": F.sum("jobs_seen").over(three), "__n": F.count("*").over(three)})
    return good.where("__seen = 0 and __n = 3").select("source_id", "run_id", "started_at")


def schedule_next(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """outcomes: source_id, ok, poll_minutes, consecutive_failures. Success waits a poll, each failure twice as long as the one before, a day at most."""
    failures = F.when(F.col("ok"), 0).otherwise(F.col("consecutive_failures") + 1)
    wait = F.when(F.col("ok"), F.col("poll_minutes").cast("double")).otherwise(F.least(F.col("poll_minutes") * F.pow(F.lit(2.0), failures), F.lit(float(MOST_MINUTES))))
    return outcomes.select("source_id", failures.cast("int").alias("consecutive_failures"), wait.alias("wait_minutes"), F.timestamp_seconds(F.unix_timestamp(as_of) + wait * 60).alias("next_check_at"))


def next_dispatch_at(last_tick: Column, every_minutes: int) -> Column:
    """When the dispatcher runs next: an interval after it last did."""
    return F.timestamp_seconds(F.unix_timestamp(last_tick) + 60 * every_minutes)


def due_sources(sources: DataFrame, companies: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Enabled sources of enabled companies that are due, quick types first."""
    c = companies.where("enabled").select(F.col("id").alias("company_id"))
    due = sources.join(c, "company_id", "left_semi").where(F.col("enabled") & (F.col("source_type") != "unsupported") & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= as_of)))
    slow = F.col("source_type").isin(*SLOW_TYPES).cast("int")
    out = due.orderBy(slow, F.asc_nulls_first("next_check_at"), "id")
    return out if limit is None else out.limit(limit)


def poll_minutes(source_type: Column, default: int = 5) -> Column:
    table = F.create_map(*(F.lit(x) for pair in POLL_MINUTES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source_type), F.lit(default))


def reapply_poll_minutes(sources: DataFrame, default: int = 5) -> DataFrame:
    """sources with the interval of their type."""
    return sources.withColumn("poll_interval_minutes", poll_minutes(F.col("source_type"), default))


def escalate_sources(sources: DataFrame, runs: DataFrame, refused: DataFrame) -> DataFrame:
    """Plain pages that stayed empty, or that answered 403 (refused: source_id), go to the browser."""
    empty = empty_streak(runs).select(F.col("source_id").alias("__id")).union(refused.select("source_id")).distinct()
    s = sources.join(empty, sources["id"] == empty["__id"], "left")
    hit = F.col("__id").isNotNull() & (F.col("source_type") == "generic_html")
    return s.select(*(
        F.when(hit, F.lit("playwright")).otherwise(F.col(c)).alias(c) if c == "source_type"
        else F.when(hit, F.lit(POLL_MINUTES["playwright"])).otherwise(F.col(c)).alias(c) if c == "poll_interval_minutes"
        else F.when(hit, 0).otherwise(F.col(c)).alias(c) if c == "consecutive_failures" else F.col(c)
        for c in sources.columns
    ))


def repoint_sources(sources: DataFrame, boards: DataFrame, default: int = 5) -> DataFrame:
    """Sources whose page turned out to front a hosted board. boards: source_id, board_type, identifier, url."""
    b = boards.select(F.col("source_id").alias("__id"), "board_type", F.col("identifier").alias("__ident"), F.col("url").alias("__url"))
    s = sources.join(b, sources["id"] == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    new = {"source_type": F.col("board_type"), "external_identifier": F.col("__ident"), "source_url": F.col("__url"), "poll_interval_minutes": poll_minutes(F.col("board_type"), default), "next_check_at": F.lit(None)}
    return s.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sources.columns))

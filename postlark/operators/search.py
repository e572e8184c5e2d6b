"""Ranked and filtered reads of matches and postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, vectors
from ..functions.vocabulary import DISMISSING, FIT_WORDS, HIDDEN_FITS, REGION_PLACES, STOP_WORDS

FARTHEST = 0.75
#: Rows of one page of list_jobs, at most.
MOST_JOBS = 500


@dataclass(frozen=True)
class Filters:
    """What a reader of the list asks for; None leaves a filter out."""

    min_score: float = 0.0
    target_role_id: int | None = None
    home_only: bool = True
    within_days: int | None = None
    query: str | None = None
    query_embedding: list[float] | None = None
    region: str | None = None
    hide_dismissed: bool = True
    seniority: str = "all"
    sort: str = "recent"
    limit: int | None = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if self.region is not None and self.region not in REGION_PLACES:
            raise ValueError(f"no region {self.region}; there are {', '.join(REGION_PLACES)}")


def hidden_fits(seniority: str, query: str | None) -> set[str]:
    """Buckets that a view hides; naming one in the search shows it."""
    low = (query or "").lower()
    return {fit for fit in HIDDEN_FITS[seniority] if not any(word in low for word in FIT_WORDS.get(fit, ()))}


def search_words(query: str) -> list[str]:
    """Words that are looked for one by one; a query of stop words alone is looked for as a whole."""
    return [w for w in query.lower().split() if len(w) > 1 and w not in STOP_WORDS] or [query.strip().lower()]


def local_midnight(as_of: Column, days_back: int, zone: str) -> Column:
    local = F.date_trunc("day", F.from_utc_timestamp(as_of, zone))
    return F.to_utc_timestamp(local - F.make_dt_interval(F.lit(days_back)), zone)


def matched_words(query: str, *columns: Column) -> Column:
    """How many of the query's words any of the columns holds; % and _ in a word stand for anything, as in a pattern."""
    total = F.lit(0)
    for word in search_words(query):
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(c.ilike(f"%{word}%"), F.lit(False))
        total = total + F.when(hit, 1).otherwise(0)
    return total


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """job_id and the action of its last feedback, by id."""
    return feedback.groupBy("job_id").agg(F.max_by("action", "id").alias("action"))


def star(matches: DataFrame, postings: DataFrame, companies: DataFrame, sources: DataFrame, roles: DataFrame, feedback: DataFrame) -> DataFrame:
    """Matches with posting, company, source, role and last feedback; sizes decide how each is joined."""
    p = postings.select(F.col("id").alias("job_id"), *(c for c in postings.columns if c != "id"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "normalized_name")
    s = sources.select(F.col("id").alias("career_source_id"), "source_type")
    r = roles.select(F.col("id").alias("target_role_id"), F.col("canonical_name").alias("role"), "max_expected_years")
    return matches.join(p, "job_id").join(c, "company_id").join(s, "career_source_id").join(r, "target_role_id").join(latest_feedback(feedback), "job_id", "left")


def _selected(rows: DataFrame, f: Filters, as_of: Column, zone: str) -> DataFrame:
    posted = F.coalesce("source_published_at", "first_seen_at")
    rows = rows.where((F.col("status") == "active") & (F.col("final_score") >= f.min_score))
    rows = rows.withColumns({"posted_at": posted, "seniority_fit": classify.level_fit(F.col("seniority"), F.col("experience_min_years"), F.col("max_expected_years"))})
    if f.home_only:
        rows = rows.where(classify.home_only(F.col("country"), F.col("location_text")))
    if f.target_role_id is not None:
        rows = rows.where(F.col("target_role_id") == f.target_role_id)
    if f.within_days is not None:
        since = local_midnight(as_of, f.within_days, zone)
        rows = rows.where((F.col("first_seen_at") >= since) | (F.col("source_published_at") >= since))
    if f.region is not None:
        rows = rows.where(F.col("region") == f.region)
    if hidden := hidden_fits(f.seniority, f.query):
        rows = rows.where(~F.col("seniority_fit").isin(*sorted(hidden)))
    if f.hide_dismissed:
        rows = rows.where(F.col("action").isNull() | ~F.col("action").isin(*DISMISSING))
    words = matched_words(f.query, F.col("normalized_title"), F.col("normalized_name")) if f.query else F.lit(0)
    rows = rows.withColumn("matched_words", words)
    if f.query and f.query_embedding is not None:
        rows = rows.withColumn("distance", vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, f.query_embedding))))
        return rows.where((F.col("matched_words") > 0) | (F.col("embedding").isNotNull() & (F.col("distance") <= FARTHEST)))
    return rows.where("matched_words > 0") if f.query else rows


def top_matches(rows: DataFrame, f: Filters, as_of: Column, zone: str = "UTC") -> DataFrame:
    """A page of star(), best first. Ties end with job and role, so that pages do not overlap."""
    got = _selected(rows, f, as_of, zone)
    last = [F.asc("job_id"), F.asc("target_role_id")]
    if f.query and f.query_embedding is not None:
        order = [F.desc("matched_words"), F.asc_nulls_last("distance"), F.desc_nulls_first("final_score")]
    elif f.sort == "score":
        order = [F.desc_nulls_first("final_score"), F.desc_nulls_first("posted_at")]
    else:
        order = [F.desc_nulls_first("posted_at"), F.desc_nulls_first("final_score")]
    got = got.orderBy(*order, *last)
    if f.limit is not None:
        got = got.limit(f.limit + f.offset)
    return got.offset(f.offset) if f.offset else got


def count_top_matches(rows: DataFrame, f: Filters, as_of: Column, zone: str = "UTC") -> DataFrame:
    return _selected(rows, f, as_of, zone).agg(F.count("*").alias("n"))


def best_per_job(matches: DataFrame) -> DataFrame:
    """Each job's match of the highest score, the lowest role first among equals."""
    best = Window.partitionBy("job_id").orderBy(F.desc("final_score"), "target_role_id")
    return matches.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def list_jobs(
    postings: DataFrame, company_id: int | None = None, source_id: int | None = None, status: str | None = None, title: str | None = None, location: str | None = None,
    home_only: bool = False, discovered_since: Column | None = None, published_since: Column | None = None, limit: int | None = 100, most: int = MOST_JOBS,
) -> DataFrame:
    """Postings by any of the filters, newest first: ``limit`` of them, or all where it is None. A limit below 1 or over ``most`` is an error."""
    if limit is not None and not 1 <= limit <= most:
        raise ValueError(f"limit has to be from 1 to {most}, not {limit}")
    rows = postings
    for column, value in (("company_id", company_id), ("career_source_id", source_id), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for column, value in (("title", title), ("location_text", location)):
        if value is not None:
            rows = rows.where(F.col(column).ilike(f"%{value}%"))
    if home_only:
        rows = rows.where(classify.home_only(F.col("country"), F.col("location_text")))
    if discovered_since is not None:
        rows = rows.where(F.col("first_seen_at") >= discovered_since)
    if published_since is not None:
        rows = rows.where(F.col("source_published_at") >= published_since)
    rows = rows.orderBy(F.desc("first_seen_at"), "id")
    return rows if limit is None else rows.limit(limit)

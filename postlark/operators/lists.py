"""Read models: plain lists and single rows for those who look at the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import Filters, count_top_matches


def get_row(rows: DataFrame, ident: int, key: str = "id") -> DataFrame:
    """One posting, profile or whatever else has an id."""
    return rows.where(F.col(key) == ident)


def list_sources(sources: DataFrame, company_id: int | None = None, enabled: bool | None = None, source_type: str | None = None) -> DataFrame:
    for column, value in (("company_id", company_id), ("enabled", enabled), ("source_type", source_type)):
        if value is not None:
            sources = sources.where(F.col(column) == value)
    return sources.orderBy("id")


def list_companies(companies: DataFrame, enabled: bool | None = None) -> DataFrame:
    return (companies if enabled is None else companies.where(F.col("enabled") == enabled)).orderBy("name", "id")


def list_roles(roles: DataFrame) -> DataFrame:
    return roles.orderBy("id")


def list_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("version"), F.desc("id"))


#: The columns of a match as it is shown, and the column of the star that each comes from; one that the star lacks is null.
MATCH = {
    "id": "match_id", "job_id": "job_id", "target_role_id": "target_role_id", "final_score": "final_score", "candidate_semantic_score": "candidate_semantic_score", "intent_semantic_score": "intent_semantic_score",
    "skill_score": "skill_score", "role_score": "role_score", "seniority_score": "seniority_score", "location_score": "location_score", "recency_score": "recency_score", "reasons": "reasons", "concerns": "concerns",
    "created_at": "created_at", "job_title": "title", "company_id": "company_id", "company_name": "company", "location_text": "location_text", "country": "country", "region": "region", "source_type": "source_type",
    "source_url": "source_url", "apply_url": "apply_url", "source_published_at": "source_published_at", "first_seen_at": "first_seen_at", "last_feedback": "action", "seniority_fit": "seniority_fit",
    "job_seniority": "seniority", "experience_min_years": "experience_min_years", "fit": "fit",
}


def match_projection(rows: DataFrame) -> DataFrame:
    """A match as it is shown, of rows of search.top_matches."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).alias(name) for name, c in MATCH.items()))


def applications_list(applications: DataFrame, postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Applications with their posting and company, the last touched first."""
    p = postings.select(F.col("id").alias("job_id"), F.col("title").alias("job_title"), "company_id", "location_text", *(c for c in ("apply_url", "source_url") if c in postings.columns), F.col("status").alias("job_status"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return applications.join(p, "job_id").join(c, "company_id").drop("company_id").orderBy(F.desc("updated_at"), "job_id")


def relevant_today(star: DataFrame, as_of: Column, zone: str = "UTC", least: float = 60) -> DataFrame:
    """How many good matches appeared since midnight."""
    return count_top_matches(star, Filters(min_score=least, within_days=0), as_of, zone)


def last_crawl_at(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("started_at").alias("last_crawl_at"))


def next_version(profiles: DataFrame) -> DataFrame:
    return profiles.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))

"""Schemas of the tables, and the keys that hold in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOADS = "source_id long, source_type string, crawl_id long, kind string, page_no int, url string, fetched_at timestamp, body string"
LISTING = "source_id long, crawl_id long, ordinal long, external_job_id string, title string, location_text string, source_url string, apply_url string, source_updated_at timestamp, source_published_at timestamp"
DETAILS = (
    "source_id long, crawl_id long, external_job_id string, title string, department string, location_text string, remote_type string, employment_type string, "
    "description string, responsibilities string, qualifications string, source_url string, apply_url string, source_published_at timestamp, source_updated_at timestamp"
)
KEYS = {
    "companies": ["normalized_name"], "sources": ["company_id", "source_url"], "postings": ["career_source_id", "external_job_id"], "candidates": ["file_hash"],
    "roles": ["canonical_name"], "matches": ["candidate_profile_id", "target_role_id", "job_id"], "applications": ["job_id"], "notifications": ["dedup_key"],
}


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, and in how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, after making sure that keys tell them apart."""
    if found := duplicates(rows, keys).limit(3).collect():
        raise ValueError(f"rows are not unique by {', '.join(keys)}: {[r.asDict() for r in found]}")
    return rows

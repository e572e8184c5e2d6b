"""What old postings keep: nothing of their text, or nothing at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = 10
_CONTENT = ("description", "normalized_description", "responsibilities", "qualifications", "embedding", "reading")


def unprotected(postings: DataFrame, feedback: DataFrame, applications: DataFrame) -> DataFrame:
    """Postings that nobody has reacted or applied to."""
    touched = [t.select(F.col("job_id").alias("__job")).distinct() for t in (feedback, applications)]
    for t in touched:
        postings = postings.join(t, F.col("id") == F.col("__job"), "left_anti")
    return postings


def prune(postings: DataFrame, matches: DataFrame, feedback: DataFrame, applications: DataFrame, as_of: Column, days: int = DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings and matches after pruning, and how many were archived and deleted.

    Old and unprotected: open ones lose their content and matches and get archived_at, closed ones go, and their matches with them.
    """
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    old = (F.col("first_seen_at") < cutoff) & (F.coalesce("source_published_at", "first_seen_at") < cutoff)
    free = unprotected(postings.where(old), feedback, applications).select(F.col("id").alias("__free"))
    p = postings.join(free, F.col("id") == F.col("__free"), "left")
    fate = F.when(F.col("__free").isNull(), "keep").when((F.col("status") == "active") & F.col("archived_at").isNull(), "archive").when(F.col("status") == "closed", "delete").otherwise("keep")
    p = p.withColumn("fate", fate)
    archived = F.col("fate") == "archive"
    columns = [F.when(~archived, F.col(c)).alias(c) if c in _CONTENT else F.when(archived, as_of).otherwise(F.col(c)).alias(c) if c == "archived_at" else F.col(c) for c in postings.columns]
    gone = p.where("fate <> 'keep'").select(F.col("id").alias("job_id"))
    counts = p.agg(F.count_if(archived).alias("archived"), F.count_if(F.col("fate") == "delete").alias("deleted"))
    return p.where("fate <> 'delete'").select(*columns), matches.join(gone, "job_id", "left_anti"), counts

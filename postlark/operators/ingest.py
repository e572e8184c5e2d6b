"""From landed answers to full posting rows: listing and details side by side, read, compared with what is stored, embedded where the text is new."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, vectors
from ..functions import text as T
from ..sources import boards
from . import crawl

READ = (
    "title string, normalized_title string, department string, location_text string, normalized_location string, country string, region string, is_abroad boolean, remote_type string, "
    "employment_type string, description string, normalized_description string, responsibilities string, qualifications string, required_skills array<string>, seniority string, "
    "experience_min_years int, source_url string, apply_url string, source_published_at timestamp, source_updated_at timestamp, details_fetched_at timestamp, embedding array<float>"
)
STORED = (
    "source_id long, external_job_id string, content_hash string, status string, missing_streak int, first_seen_at timestamp, last_seen_at timestamp, archived_at timestamp, " + READ
)


def read_postings(listing: DataFrame, details: DataFrame, as_of: Column) -> DataFrame:
    """Listing rows (the first of each id) with what their details say: the columns of apply_crawl, of READ but for the embedding, and embedding_text.

    A listing without details is a posting that was not fetched: its content_hash is null. details may carry fetch_error
    and unavailable for those that could not be read. Of several details of a posting one that could be read counts, then one
    with text, then that of the lowest ``rank`` (a column, 0 where it is missing): so what a page says stands in for a board's
    answer that has no text.
    """
    d = details
    for c, kind in (("fetch_error", "string"), ("unavailable", "boolean")):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast(kind))
    keys = ["source_id", "crawl_id", "external_job_id"]
    rank = F.coalesce(F.col("rank"), F.lit(0)) if "rank" in d.columns else F.lit(0)
    said = F.coalesce(F.trim("description") != "", F.lit(False)) | F.coalesce(F.trim("qualifications") != "", F.lit(False)) | F.coalesce(F.trim("responsibilities") != "", F.lit(False))
    fields = [c for c in d.columns if c not in (*keys, "rank")]
    first = F.struct(F.coalesce(F.col("fetch_error").isNotNull() | F.col("unavailable"), F.lit(False)), ~said, rank, F.xxhash64(*fields))
    d = d.groupBy(*keys).agg(F.min_by(F.struct(*fields), first).alias("d"))
    both = crawl.first_of_each_id(listing).join(d, keys, "left")
    x = F.col("d")
    fetched = x.isNotNull() & x["fetch_error"].isNull() & ~F.coalesce(x["unavailable"], F.lit(False))
    rows = both.select(
        *keys, "ordinal", F.coalesce(T.blank_to_null(x["title"]), "title").alias("title"), x["department"].alias("department"), F.coalesce(T.blank_to_null(x["location_text"]), "location_text").alias("location_text"),
        F.coalesce(x["remote_type"], F.lit("unknown")).alias("remote_type"), F.coalesce(x["employment_type"], F.lit("unknown")).alias("employment_type"), x["description"].alias("description"),
        x["responsibilities"].alias("responsibilities"), x["qualifications"].alias("qualifications"), T.safe_link(F.coalesce(x["source_url"], "source_url")).alias("source_url"),
        T.safe_link(F.coalesce(x["apply_url"], "apply_url")).alias("apply_url"), F.coalesce(x["source_published_at"], "source_published_at").alias("source_published_at"),
        F.coalesce(x["source_updated_at"], "source_updated_at").alias("source_updated_at"), x["fetch_error"].alias("fetch_error"), F.coalesce(x["unavailable"], F.lit(False)).alias("unavailable"), fetched.alias("__fetched"),
    )
    rows = rows.withColumns({
        "normalized_title": T.collapsed(F.col("title")), "normalized_location": T.normalize_location(F.col("location_text")), "country": classify.country(F.col("location_text")),
        "region": classify.region(F.col("location_text")), "is_abroad": classify.clearly_abroad(F.col("location_text")), "normalized_description": T.normalized_description(F.col("description")),
        "details_fetched_at": F.when(F.col("__fetched"), as_of),
    })
    text = F.coalesce(T.blank_to_null(F.col("qualifications")), "normalized_description")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "__level": classify.assess_level(F.col("title"), text), "required_skills": none,
        "embedding_text": T.embedding_text(F.col("title"), F.col("department"), F.col("location_text"), F.col("employment_type"), none, none, F.col("responsibilities"), F.col("qualifications"), F.col("description")),
    })
    return rows.withColumns({
        "seniority": F.col("__level.level"), "experience_min_years": F.col("__level.years"), "content_hash": F.when(F.col("__fetched"), T.content_hash(F.col("embedding_text"))),
    }).drop("__level", "__fetched")


def ingest(
    payloads: DataFrame, stored: DataFrame, runs: DataFrame, as_of: Column, embed: Callable[[Column], Column] = vectors.hashed_terms, more_details: DataFrame | None = None,
    types: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The postings after a crawl, and a count for each run. payloads: landed answers; runs: source_id, crawl_id, listing_error.

    more_details: details that come from elsewhere than payloads, such as page_details (``page_fallback``), or reading errors. Only postings
    that are new, or whose text is, meet ``embed``; the others keep their vector. types: the kinds of boards among the
    payloads, where they are known.
    """
    details = boards.details_from_payloads(payloads, types)
    if more_details is not None:
        details = details.unionByName(more_details, allowMissingColumns=True)
    return ingest_rows(read_postings(boards.listing_from_payloads(payloads, types), details, as_of), stored, runs, as_of, embed)


def page_fallback(page_details: DataFrame, pages: DataFrame) -> DataFrame:
    """What pages of postings say as details, behind any answer of a board that has text. pages: page_id, source_id, crawl_id, external_job_id."""
    rows = page_details.where("not listing").join(pages.select("page_id", "source_id", "crawl_id", "external_job_id"), "page_id")
    return rows.select("source_id", "crawl_id", "external_job_id", "title", "location_text", "employment_type", "description", "source_published_at", "source_updated_at", F.lit(1).alias("rank"))


def ingest_rows(rows: DataFrame, stored: DataFrame, runs: DataFrame, as_of: Column, embed: Callable[[Column], Column] = vectors.hashed_terms) -> tuple[DataFrame, DataFrame]:
    """As ``ingest``, from the rows of read_postings."""
    old = stored.select("source_id", "external_job_id", F.col("content_hash").alias("__hash"), F.col("archived_at").alias("__archived"), F.col("embedding").alias("__vector"))
    gated = rows.join(old, ["source_id", "external_job_id"], "left")
    fresh = F.col("content_hash").isNotNull() & (~F.col("content_hash").eqNullSafe(F.col("__hash")) | F.col("__archived").isNotNull())
    gated = gated.withColumn("embedding", F.when(fresh, embed(F.col("embedding_text"))).otherwise(F.col("__vector"))).drop("__hash", "__archived", "__vector", "embedding_text")
    return crawl.apply_crawl(gated, stored, runs, as_of)


def reclassify_locations(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with country and region read anew, and how many changed."""
    new = postings.withColumns({"__country": classify.country(F.col("location_text")), "__region": classify.region(F.col("location_text"))})
    changed = ~F.col("country").eqNullSafe(F.col("__country")) | ~F.col("region").eqNullSafe(F.col("__region"))
    out = postings.columns
    after = new.select(*(F.col({"country": "__country", "region": "__region"}.get(c, c)).alias(c) for c in out))
    return after, new.agg(F.count_if(changed).alias("changed"))


def reassess_seniority(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open postings with level and years read anew, others as they are, and how many changed; the scores are due where they did."""
    text = F.coalesce(T.blank_to_null(F.col("qualifications")), T.blank_to_null(F.col("normalized_description")), F.lit(""))
    new = postings.withColumn("__read", classify.assess_level(F.col("title"), text))
    open_ = F.col("status") == "active"
    level, years = (F.when(open_, F.col(f"__read.{a}")).otherwise(F.col(b)) for a, b in (("level", "seniority"), ("years", "experience_min_years")))
    changed = ~F.col("seniority").eqNullSafe(level) | ~F.col("experience_min_years").eqNullSafe(years)
    after = new.select(*((level.alias(c) if c == "seniority" else years.alias(c) if c == "experience_min_years" else F.col(c)) for c in postings.columns))
    return after, new.agg(F.count_if(changed).alias("changed"))


def needs_reading(postings: DataFrame) -> DataFrame:
    """Postings whose stored reading is of another text, or that have none. reading: struct with content_hash."""
    return postings.where(~F.col("reading.content_hash").eqNullSafe(F.col("content_hash")))

"""Landed snapshots as a stream: pages are held back until their snapshot is whole, then go through the same ingest as a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import ingest
from ..operators.tables import BUCKETS, BucketTable
from ..sources import boards

#: What lands: an answer in each row; pages says how many the snapshot has, and a listing that failed is one row with its error.
LANDED = "source_id long, source_type string, crawl_id long, kind string, page_no int, url string, fetched_at timestamp, body string, pages int, listing_error string"
_WHOLE = "source_id long, crawl_id long, at timestamp, day date, listing_error string"
_SEEN = "seen array<string>, at timestamp, first timestamp, listing_error string"


def _collect(key: tuple, parts: Iterator[pd.DataFrame], state, delay_ms: int) -> Iterator[pd.DataFrame]:
    """Which answers of a snapshot have landed; a row once all have. What is never whole goes when its time is over."""
    if state.hasTimedOut:
        state.remove()
        return
    seen, at, first, error = state.get if state.exists else ([], None, None, None)
    known, wanted = set(seen), None
    for part in parts:
        known |= {f"{k}:{n}" for k, n in zip(part["kind"], part["page_no"], strict=True)}
        wanted = max(x for x in (wanted, int(part["pages"].max())) if x is not None)
        at = max(x for x in (at, part["fetched_at"].max().to_pydatetime()) if x is not None)
        first = min(x for x in (first, part["fetched_at"].min().to_pydatetime()) if x is not None)
        error = next((e for e in part["listing_error"] if isinstance(e, str)), error)
    if error is not None or wanted is not None and len(known) >= wanted:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"source_id": [key[0]], "crawl_id": [key[1]], "at": [at], "day": [first.date()], "listing_error": [error]})
        return
    state.update((sorted(known), at, first, error))
    ends = int(at.timestamp() * 1000) + delay_ms
    if ends > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(ends)
    else:
        state.remove()


def whole_snapshots(pages: DataFrame, delay_minutes: int = 24 * 60) -> DataFrame:
    """source_id, crawl_id, at, day, listing_error of each snapshot, once, when its last answer has landed or its listing has failed.

    pages: a stream with the columns of LANDED. State is a row for each snapshot that is under way: names of answers, no
    bodies; it goes with the snapshot, or when the watermark on fetched_at is delay_minutes past it.
    """
    rows = pages.select("source_id", "crawl_id", "kind", "page_no", "pages", "fetched_at", "listing_error").withWatermark("fetched_at", f"{delay_minutes} minutes")
    return rows.groupBy("source_id", "crawl_id").applyInPandasWithState(
        lambda key, parts, state: _collect(key, parts, state, delay_minutes * 60_000), _WHOLE, _SEEN, "append", "EventTimeTimeout"
    )


class PostingStore(BucketTable):
    """Postings, full rows of ``ingest.STORED``, in buckets by source; applied_at is the time of the last snapshot of their source."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path, f"{ingest.STORED}, action string, applied_at timestamp", "source_id", buckets)

    def apply(self, snapshots: DataFrame, landed: DataFrame, embed: Callable[[Column], Column] = vectors.hashed_terms, types: Iterable[str] | None = None) -> list[list[int]]:
        """Takes whole snapshots (columns of whole_snapshots) of landed answers, each source's in order of time; returns the buckets of each round.

        A snapshot that is no later than what its source's postings have seen changes nothing, so that one that comes late,
        or again, is left out.
        """
        todo = snapshots.groupBy("source_id", "crawl_id").agg(F.max("at").alias("at"), F.min("day").alias("day"), F.max("listing_error").alias("listing_error"))
        buckets = self.touched(todo)
        if not buckets:
            return []
        before = self.read(buckets).groupBy("source_id").agg(F.max("applied_at").alias("before"))
        order = Window.partitionBy("source_id").orderBy("at", "crawl_id")
        due = todo.join(before, "source_id", "left").where(F.col("before").isNull() | (F.col("at") > F.col("before"))).withColumn("turn", F.row_number().over(order)).drop("before")
        due = self._noted(due, "due")
        turns = range(1, (due.agg(F.max("turn")).first()[0] or 0) + 1)
        if not turns:
            return []
        # Answers lie by day, so that those of other days are not read. What they say is read once for all turns.
        answers = landed.join(due.select("source_id", "crawl_id", F.col("day").alias("__from")), ["source_id", "crawl_id"]).where((F.col("day") >= F.col("__from")) & F.col("body").isNotNull()).drop("__from", "day")
        answers = answers.dropDuplicates(["source_id", "crawl_id", "kind", "page_no", "url"])
        rows = ingest.read_postings(boards.listing_from_payloads(answers, types), boards.details_from_payloads(answers, types), F.lit(None).cast("timestamp"))
        rows = self._noted(rows.join(due.select("source_id", "crawl_id", "turn", F.col("at").alias("__at")), ["source_id", "crawl_id"]), "read")
        rows = rows.withColumn("details_fetched_at", F.when(F.col("content_hash").isNotNull(), F.col("__at"))).drop("__at")
        return [self._turn(due.where(F.col("turn") == n).drop("turn"), rows.where(F.col("turn") == n).drop("turn"), embed) for n in turns]

    def _noted(self, rows: DataFrame, name: str) -> DataFrame:
        """rows as they are now, beside the table."""
        path = f"{self.path}/_{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _turn(self, due: DataFrame, rows: DataFrame, embed) -> list[int]:
        buckets = self.touched(due)
        stored = self.read(buckets)
        runs = due.select("source_id", "crawl_id", "listing_error", "at")
        after, _ = ingest.ingest_rows(rows, stored.drop("action", "applied_at"), runs, F.lit(None).cast("timestamp"), embed)
        seen = due.select(F.col("source_id").alias("__s"), F.col("at").alias("__at"))
        old = stored.select("source_id", "external_job_id", F.col("applied_at").alias("__applied"), F.col("action").alias("__action"))
        after = after.join(seen, F.col("source_id") == F.col("__s"), "left").join(old, ["source_id", "external_job_id"], "left")
        new = F.col("__at").isNotNull()
        after = after.withColumns({"applied_at": F.coalesce("__at", "__applied"), "action": F.when(new, F.col("action")).otherwise(F.col("__action"))})
        self.replace(after.select(*self.columns), buckets)
        return buckets


def land(answers: DataFrame, path: str) -> None:
    """Adds answers (columns of LANDED) to the landed ones, by day."""
    answers.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("day").parquet(path)


def stream_crawls(spark: SparkSession, landed: str, store: PostingStore, checkpoint: str, embed: Callable[[Column], Column] = vectors.hashed_terms, types: Iterable[str] | None = None, files: int = 1000, delay_minutes: int = 24 * 60):
    """Starts the query over what ``land`` writes; runs through what is there and stops.

    The base of every batch is what the store holds, whatever the checkpoint: a new one goes through all that has landed
    again, and what has been applied is left out.
    """
    schema = f"{LANDED}, day date"
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)

    def apply(batch: DataFrame, epoch: int) -> None:
        store.apply(batch, batch.sparkSession.read.schema(schema).parquet(landed), embed, types)

    return whole_snapshots(pages, delay_minutes).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

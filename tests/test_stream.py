"""The stream of snapshots against the same snapshots one by one, and tables in buckets."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from postlark.operators import ingest
from postlark.operators.tables import BucketTable
from postlark.sources import boards
from postlark.streaming import crawls

DAY = datetime.datetime(2024, 1, 1)


def answers(source, crawl, ids, pages=2, error=None, day=None, lost=()):
    """The answers of one snapshot: its jobs dealt to pages."""
    at = DAY + datetime.timedelta(days=crawl if day is None else day)
    if error:
        return [(source, "ashby", crawl, "listing", 0, "https://x", at, None, pages, error)]
    body = lambda k: json.dumps({"jobs": [{"id": i, "title": f"Dev {i}", "location": "Haifa", "descriptionPlain": f"text {t}"} for n, (i, t) in enumerate(ids) if n % pages == k]})
    return [(source, "ashby", crawl, "listing", k, "https://x", at, body(k), pages, None) for k in range(pages) if k not in lost]


def land(spark, rows, path):
    crawls.land(spark.createDataFrame(rows, crawls.LANDED).coalesce(1), path)


def run(spark, tmp, store, check="check", **how):
    crawls.stream_crawls(spark, f"{tmp}/landed", store, f"{tmp}/{check}", types=["ashby"], embed=lambda t: F.array(F.length(t).cast("float")), **how).awaitTermination()


def state(rows):
    return sorted((r["source_id"], r["external_job_id"], r["status"], r["missing_streak"], r["content_hash"], r["first_seen_at"], r["last_seen_at"]) for r in rows.collect())


def one_by_one(spark, snapshots):
    """The same by ``ingest``, a snapshot at a time in order."""
    stored = spark.createDataFrame([], ingest.STORED)
    for rows in snapshots:
        landed = spark.createDataFrame(rows, crawls.LANDED)
        runs = landed.groupBy("source_id", "crawl_id").agg(F.max("listing_error").alias("listing_error"))
        at = F.lit(rows[0][6]).cast("timestamp")
        found = ingest.read_postings(boards.listing_from_payloads(landed.where("body is not null"), ["ashby"]), boards.details_from_payloads(landed.where("body is not null"), ["ashby"]), at)
        after, _ = ingest.ingest_rows(found, stored, runs, at, lambda t: F.array(F.length(t).cast("float")))
        stored = spark.createDataFrame(after.select(*stored.columns).collect(), ingest.STORED)
    return state(stored)


@pytest.fixture(scope="module")
def snapshots():
    rng = random.Random(2)
    out = []
    for crawl in range(3):
        for source in (1, 2):
            ids = [(f"j{i}", rng.choice("ab") if i == 3 else "a") for i in range(6) if rng.random() < 0.6]
            out.append(answers(source, crawl, ids, error="Timeout" if (source, crawl) == (2, 2) else None))
    out[2] = answers(1, 1, [])  # an empty listing
    return out


def test_stream_gives_what_batches_give(spark, tmp_path, snapshots):
    """Split answers, an empty and a failed listing; two files a batch, then all of them in one by a new checkpoint."""
    rows = [r for s in snapshots for r in s]
    for k in range(0, len(rows), 3):  # answers of a snapshot in different files
        land(spark, rows[k : k + 3], f"{tmp_path}/landed")
    want = one_by_one(spark, snapshots)
    store = crawls.PostingStore(spark, f"{tmp_path}/a", buckets=16)
    run(spark, tmp_path, store, files=2)
    assert state(store.read()) == want
    # A new checkpoint goes through everything again: nothing is lost, nothing ages twice.
    run(spark, tmp_path, store, check="fresh")
    assert state(store.read()) == want


def test_late_and_unfinished_snapshots(spark, tmp_path):
    store = crawls.PostingStore(spark, f"{tmp_path}/store", buckets=8)
    land(spark, answers(1, 0, [("a", "x"), ("b", "x")]) + answers(1, 2, [("a", "x"), ("c", "x")], lost=(1,)), f"{tmp_path}/landed")
    run(spark, tmp_path, store)
    assert {r["external_job_id"] for r in store.read().collect()} == {"a", "b"}  # the second has one of two answers
    land(spark, answers(1, 2, [("a", "x"), ("c", "x")], lost=(0,)), f"{tmp_path}/landed")
    run(spark, tmp_path, store)
    got = {r["external_job_id"]: (r["status"], r["missing_streak"]) for r in store.read().collect()}
    assert got == {"a": ("active", 0), "b": ("active", 1), "c": ("active", 0)}
    land(spark, answers(1, 1, [("z", "x")]), f"{tmp_path}/landed")  # older than what has been applied
    run(spark, tmp_path, store)
    assert {r["external_job_id"]: (r["status"], r["missing_streak"]) for r in store.read().collect()} == got
    full = store.read().first()
    assert full["region"] == "haifa" and full["embedding"] and full["normalized_title"].startswith("dev ")


def test_buckets(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "k long, v long", "k", buckets=512)
    assert table.read().count() == 0
    old = spark.range(400).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    table.replace(old, table.touched(old))
    files = lambda: {(f.parent.name, f.name) for f in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    new = spark.createDataFrame([(7, 5), (8, 5), (400, 5), (401, 5)], "k long, v long")
    touched = table.upsert(new, ["k"])
    kept = before & files()
    assert len(touched) <= 4 and {b for b, _ in before - kept} <= {f"bucket={b}" for b in touched} and len(kept) >= len(before) - 4
    want = {**{k: 1 for k in range(400)}, 7: 5, 8: 5, 400: 5, 401: 5}
    for _ in range(2):
        assert {r["k"]: r["v"] for r in table.read().collect()} == want and table.read().count() == 402
        table.upsert(new, ["k"])
    table.delete(spark.createDataFrame([(7,)], "k long"))
    assert {r["k"] for r in table.read().collect()} == set(want) - {7} and table.read([]).count() == 0
    plan = table.read([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_lost_driver(spark, tmp_path):
    """Lost after the change was written whole: opening finishes it. Lost before: the table is as it was."""
    table = BucketTable(spark, f"{tmp_path}/t", "k long, v long", "k", buckets=4)
    old = spark.range(20).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    table.replace(old, table.touched(old))
    finish, table._finish = table._finish, lambda: None
    table.upsert(spark.createDataFrame([(3, 9)], "k long, v long"), ["k"])
    assert {r["v"] for r in table.read().collect()} == {1}
    again = BucketTable(spark, f"{tmp_path}/t", "k long, v long", "k", buckets=4)
    assert again.read().count() == 20 and again.read().where("k = 3").first()["v"] == 9
    again._finish = lambda: None
    again.upsert(spark.createDataFrame([(4, 9)], "k long, v long"), ["k"])
    again._delete(f"{again._staged}/buckets")
    assert BucketTable(spark, f"{tmp_path}/t", "k long, v long", "k", buckets=4).read().where("v = 9").count() == 1

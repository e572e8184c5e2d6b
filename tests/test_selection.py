"""Medians by counting passes, islands of missed crawls, the trigram index, notifications once, and refusals."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from postlark.operators import crawl, reports, search, text_index


def test_medians(spark, monkeypatch):
    rng = random.Random(1)
    classes = {
        "even": [rng.gauss(0, 1) for _ in range(500)], "odd": [rng.expovariate(1) for _ in range(501)], "same": [2.5] * 400, "ties": [rng.choice([1.0, 2.0, 3.0]) for _ in range(300)], "one": [7.0], "two": [1.0, 2.0],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-40, 40) for _ in range(301)], "ends": [-1.7e308, 1.7e308] * 30 + [5.0], None: [1.0, 4.0, 9.0], "none": [],
    }
    rows = [(k, v) for k, vs in classes.items() for v in vs] + [("none", None), ("odd", None), ("odd", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, score double").repartition(3)
    monkeypatch.setattr(reports, "FEW", 20)
    monkeypatch.setattr(reports, "BINS", 64)
    got = {r["kind"]: (r["median_score"], r["n"]) for r in reports.median_by_class(df, "kind", "score").collect()}
    for k, vs in classes.items():
        middle, n = got[k]
        assert n == len(vs) + {"none": 1, "odd": 2}.get(k, 0)
        assert middle == pytest.approx(statistics.median(vs), rel=1e-12) if vs else middle is None
    assert reports.median_by_class(df.limit(0), "kind", "score").count() == 0


def test_hot_class_is_never_gathered(spark):
    """A class of a million rows: what a pass leaves in one group is few rows or counts."""
    df = spark.range(1_000_001).select(F.lit("hot").alias("kind"), ((F.col("id") * 7919) % 1_000_001).cast("double").alias("score"))
    assert [tuple(r) for r in reports.median_by_class(df, "kind", "score").collect()] == [("hot", 500_000.0, 1_000_001)]


def test_islands(spark):
    rng = random.Random(2)
    crawls = [(s, c) for s in (1, 2) for c in range(0, 60, 2)]
    seen = [(s, j, c) for s, c in crawls for j in "abcd" if rng.random() < {"a": 0.95, "b": 0.5, "c": 0.1, "d": 1}[j]]
    snaps, all_ = spark.createDataFrame(seen + seen[:5], "source_id long, external_job_id string, crawl_no int"), spark.createDataFrame(crawls, "source_id long, crawl_no int")
    want = []
    for s in (1, 2):
        for j in "abcd":
            streak = None
            for c in range(0, 60, 2):
                streak = 0 if (s, j, c) in seen else None if streak is None else streak + 1
                if streak is not None:
                    want.append((s, j, c, streak))
    assert sorted(tuple(r) for r in crawl.missing_streaks(snaps, all_).collect()) == sorted(want)
    islands = crawl.streak_islands(snaps, all_)
    assert islands.where("external_job_id = 'd'").count() == 2 and islands.count() < len(want) / 2
    at = crawl.numbered_crawls(all_).where("crawl_no = 30")
    assert sorted((r["source_id"], r["external_job_id"], r["missing_streak"]) for r in crawl.streak_at(islands, at).collect()) == sorted((s, j, k) for s, j, c, k in want if c == 30)


def test_trigrams(spark, tmp_path):
    rng = random.Random(3)
    titles = ["".join(rng.choices(["dev", "ops ", "İstanbul", "data_", "50%", " lead", "é", "x"], k=rng.randint(0, 5))) for _ in range(400)] + [None, "", "ab"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    index = text_index.TrigramIndex(spark, f"{tmp_path}/i", buckets=32).build(rows.where("id % 2 = 0"), "t").add(rows.where("id % 2 = 1"), "t")
    for query in ("devops", "DATA_", "50%", "lead é", "i̇stanbul", "a", "v_op", "the opsdev data", "zzz"):
        match = rows.where(search.matched_words(query, F.col("t")) > 0)
        found = index.candidates(query)
        if found is None:
            assert any(len(w.replace("%", "_").split("_")[0]) < 3 for w in search.search_words(query))
            continue
        assert match.join(found, "id", "left_anti").count() == 0, query
        held = {r["id"] for r in found.collect()}
        assert len(held) < 300
    plan = index.candidates("devops")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_notifications_once(spark, tmp_path):
    schema = "job_id long, channel string, created_at timestamp"
    batches = [[(1, "mail", "2024-01-01 10:00:00"), (1, "mail", "2024-01-01 11:00:00"), (1, "app", "2024-01-01 11:00:00")], [(1, "mail", "2024-01-02 10:00:00"), (2, "mail", "2024-01-02 10:00:00")]]
    for rows in batches:  # a restart between them
        spark.createDataFrame(rows, "job_id long, channel string, t string").select("job_id", "channel", F.col("t").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        once = reports.notifications_once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["dedup_key"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1:app", "1:mail", "2:mail"]
    assert sorted(r["dedup_key"] for r in reports.notifications_once(spark.read.schema(schema).parquet(f"{tmp_path}/in")).collect()) == ["1:app", "1:mail", "2:mail"]


def test_refusals(spark):
    rows = spark.range(900).select("id", F.lit(None).cast("timestamp").alias("first_seen_at"))
    assert search.list_jobs(rows, limit=None).count() == 900 and search.list_jobs(rows, limit=800, most=1000).count() == 800
    for wrong in (0, 1200):
        with pytest.raises(ValueError):
            search.list_jobs(rows, limit=wrong)
    with pytest.raises(ValueError):
        search.Filters(region="atlantis")
    assert search.Filters(region="haifa").region == "haifa"

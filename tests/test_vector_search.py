"""Vector searches against brute force: exact ones row by row, approximate ones by recall and by the share of pairs they compare."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.functions import vectors
from postlark.operators import vector_search as V

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)


def distances(q, x):
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
    return 1 - a @ b.T


def pairs(df):
    return {(r["query_id"], r["row_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def cloud():
    """400 places in 32 dimensions with 8 rows near each: thousands of real pairs."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    return np.repeat(base, 8, 0) + 0.35 * rng.standard_normal((3200, 32))


def test_exact_searches(spark, cloud):
    x = cloud[:600]
    rows, some = frame(spark, x), frame(spark, x).where("id % 20 = 0")
    d = distances(x[::20], x)
    got = V.within_distance(rows, some, 0.3, "id", "id", "v", part_rows=100, part_queries=7)
    assert pairs(got) == {(20 * i, j) for i, j in zip(*np.nonzero(d <= 0.3), strict=True)} and got.count() > 200
    top = {(20 * i, int(j)) for i in range(len(d)) for j in np.argsort(d[i], kind="stable")[:5]}
    assert pairs(V.nearest_in_blocks(rows, some, 5, "id", "id", "v", part_rows=100, part_queries=7)) == top
    assert pairs(vectors.nearest(rows, some, 5, "id", "id", "v")) == top
    file = V.InvertedFile(rows, "id", "v")
    assert pairs(file.search(some, 5, "id", "v", exact=True, probes=1, part_rows=50, part_queries=3)) == top


def test_bands_prune_and_find(spark, cloud):
    rows = frame(spark, cloud)
    d = distances(cloud, cloud)
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.3), strict=True)}
    found = pairs(V.band_join(rows, rows, 0.3, "id", "id", "v", part_rows=500))
    assert len(true) > 10_000 and found <= true and len(found) >= 0.9 * len(true)
    assert V.compared_share(rows, rows, 0.3, "id", "id", "v") < 0.1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_bands_prune_the_given_vectors(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    after = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    mixed = e.join(after, "id").select("id", F.zip_with("v", "w", lambda a, b: a.cast("double") + b.cast("double")).alias("v"))
    true = pairs(V.within_distance(e, mixed, 0.4, "id", "id", "v"))
    found = pairs(V.band_join(e, mixed, 0.4, "id", "id", "v"))
    assert len(true) > 900 and found <= true and len(found) >= 0.9 * len(true)
    assert V.compared_share(e, mixed, 0.4, "id", "id", "v") < 0.1


def test_hot_key_is_dealt(spark):
    """A third of all rows are one vector: they meet in parts, and all of their pairs are found."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.standard_normal(16), (300, 1)), rng.standard_normal((600, 16))])
    rows = frame(spark, x)
    got = V.band_join(rows, rows.where("id < 100"), 0.2, "id", "id", "v", part_rows=50, part_queries=20).where("query_id < 100 and row_id < 300")
    assert got.count() == 100 * 300
    r, q = (V.banded(V._ready(df, "id", "v", n), n, 6, 2).where("bucket < 64") for df, n in ((rows, "row_id"), (rows, "query_id")))
    sizes = {b["bucket"]: b["rows"] for b in V.bucket_sizes(r, q).collect()}
    assert max(sizes.values()) >= 300


def test_inverted_file_recall_and_lists(spark, cloud, tmp_path):
    rows = frame(spark, cloud)
    some = rows.where("id % 20 = 0")
    d = distances(cloud[::20], cloud)
    top = {(20 * i, int(j)) for i in range(len(d)) for j in np.argsort(d[i], kind="stable")[:10]}
    file = V.InvertedFile(rows, "id", "v", path=f"file://{tmp_path}/lists")
    assert file.lists.count() == len(cloud) and file.lists.where("bucket = 3").inputFiles()
    found = pairs(file.search(some, 10, "id", "v"))
    assert len(found) == len(top) and len(found & top) >= 0.9 * len(top)
    assert V.probes_for(file.sample, file.centres, 10, 0.95) < 0.5 * len(file.centres)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_inverted_file_on_the_given_vectors(spark):
    """They have no clusters, so that many lists are needed: recall is what is held."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id % 20 = 0")
    top = pairs(V.nearest_in_blocks(e, q, 10, "id", "id", "v"))
    assert len(pairs(V.InvertedFile(e, "id", "v").search(q, 10, "id", "v")) & top) >= 0.9 * len(top)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [float("nan"), 1.0])], "id long, v array<double>")
    for got in (V.within_distance(rows, rows, 0.1, "id", "id", "v"), V.nearest_in_blocks(rows, rows, 2, "id", "id", "v"), V.InvertedFile(rows, "id", "v").search(rows, 2, "id", "v"), V.band_join(rows, rows, 0.1, "id", "id", "v")):
        assert pairs(got) == {(1, 1), (1, 4), (4, 1), (4, 4)}
    none = rows.limit(0)
    assert V.nearest_in_blocks(none, rows, 2, "id", "id", "v").count() == 0 and V.InvertedFile(none, "id", "v").search(rows, 2, "id", "v").count() == 0 and V.within_distance(rows, none, 0.1, "id", "id", "v").count() == 0
    with pytest.raises(ValueError):
        V.band_plan(0.95)


def test_band_join_sends_small_rows_and_loses_no_pair_that_meets(spark):
    """The pairs of a plain join of the bands, also with copies, equal and null ids and small parts; a query is sent once to a block, not for each probe."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((60, 8)), 5, 0) + 0.1 * rng.standard_normal((300, 8))
    x[:40] = x[0]
    rows = [(None if i == 7 else i // 2 if i > 250 else i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    bits, tables, probes = V.band_plan(0.2)
    r, q = (V._ready(df, "id", "v", c) for c in ("row_id", "query_id"))
    plain = V.compare(V.banded(r, "row_id", bits, tables), V.banded(q, "query_id", bits, tables, probes), most=0.2)
    want = {(a, b): d for a, b, d in plain.groupBy("query_id", "row_id").agg(F.min("distance")).collect()}
    for parts in (8192, 20):
        got = {(a, b): d for a, b, d in V.band_join(df, df, 0.2, "id", "id", "v", part_rows=parts, part_queries=parts).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) > 1_600
    sent = q.mapInArrow(lambda b: V._packed(b, "query_id", bits, tables, probes, 7, 2), "block long, query_id long, keys array<int>, codes binary, step double, off double")
    n, keys = sent.agg(F.count("*"), F.sum(F.size("keys"))).first()
    assert keys == 300 * tables * probes and n <= 300 * tables * min(4, probes)

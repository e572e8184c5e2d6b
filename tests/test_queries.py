"""Registered queries against their SQL on the smallest tables, where those are there."""

import datetime
import os

import pytest

from postlark.plans import catalog
from postlark.plans.views import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df, sql = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(dict(zip(sql.columns, r, strict=True))[c]) for c in columns)) for r in sql.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_posting_reading_reads_late_places(spark, tmp_path):
    long = "We make parts for machines and ship them to all who ask for them in time. " * 40
    texts = {1: long + "The office is in Haifa.", 2: "Haifa. " + long + "Then Tel Aviv.", 3: long, 4: None, 5: long + "Kiryat-Gat", 6: long + "Anywhere in Israel"}
    spark.createDataFrame([(i, t, "src") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["country"], r["region"]) for r in catalog.QUERIES["posting_reading"](spark, str(tmp_path)).collect()}
    assert got == {1: ("Israel", "haifa"), 2: ("Israel", "haifa"), 3: (None, None), 4: (None, None), 5: ("Israel", "south"), 6: ("Israel", None)}


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query with SQL gives the rows that DuckDB gives on the same files."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(DATA, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def sort_key(row):
    return [(v is not None, str(v)) for v in row]


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rel = duck.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=sort_key)
    at = [rel.columns.index(c) for c in names]
    want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=sort_key)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", ["cluster_metaphone"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

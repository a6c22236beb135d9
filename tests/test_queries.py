"""Every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from cueframe import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return pd.Timestamp(x).isoformat() if hasattr(x, "isoformat") else repr(x)


def same(spark, query, sql, data=DATA):
    got = query(spark, data)
    columns = sorted(got.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, name):
    same(spark, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql(spark, name):
    got = plans.QUERIES[name](spark, DATA)
    assert got.count() > 0 and got.columns


def test_placements_are_ordered(spark):
    rows = plans.QUERIES["rate_placements"](spark, DATA).collect()
    assert all(x.place_end >= x.place_start and x.extra_tempo >= 1 for x in rows)
    times = plans.QUERIES["time_map"](spark, DATA).orderBy("track_id", "at_ms").collect()
    assert all(b.out_ms >= a.out_ms for a, b in zip(times, times[1:]) if a.track_id == b.track_id)


def test_segments_keep_the_text(spark):
    rows = plans.QUERIES["rule_segments"](spark, DATA).collect()
    assert all(x.end_ms >= x.start_ms and x.text.strip() for x in rows)


def test_aligned_rows_never_overlap(spark):
    rows = plans.QUERIES["aligned_text"](spark, DATA).orderBy("track_id", "seg_idx").collect()
    assert all(a.end_ms <= b.start_ms for a, b in zip(rows, rows[1:]) if a.track_id == b.track_id)
    assert all(0 <= x.match_rate <= 1 for x in rows)

"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from strophe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = Counter(tuple(rounded(r[c]) for c in cols) for r in got.collect())
    assert rows == Counter(tuple(rounded(x) for x in r) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0 or name == "q_locate"  # too few peaks for a segment in the smallest tables


def test_match_timings_reads_every_line(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog.resolve, "match_timings", lambda lines, timings, song: seen.update(lines=lines.count(), timings=timings.count()) or lines)
    catalog.QUERIES["q_match_timings"](spark, SF)
    assert seen["lines"] == seen["timings"] > 0

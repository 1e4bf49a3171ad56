"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from scoutflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    frame = registry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = plain(tuple(r[c] for c in columns) for r in frame.collect())
    want = duck.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == plain(tuple(r[i] for i in at) for r in want.fetchall())

"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import catalog, catalog_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted((tuple(value(r[n]) for n in names) for r in rows), key=repr)


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    df = query(spark, SF)
    assert sorted(df.columns) == names
    got = [r.asDict() for r in df.collect()]
    assert len(got) == len(want)
    assert plain(got, names) == plain(want, names), name


@pytest.mark.parametrize("name", sorted(catalog_sql.ORACLES))
def test_oracle(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog_sql.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog_sql.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = {"win_trend_latest", "agg_volume_profile_rows", "agg_poc", "win_gaussian_smooth"}  # their parts are covered by the others


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=key)
    assert ours == theirs

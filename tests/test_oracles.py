"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lumiframe.plans import catalog, records  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "orders part events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    cur = duck.execute(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in cur.description)
    place = [[c[0] for c in cur.description].index(c) for c in columns]
    want = sorted(tuple(shown(r[i]) for i in place) for r in cur.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

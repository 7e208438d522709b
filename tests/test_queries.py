"""Every library query against its SQL on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from orthant.plans import queries

TABLES = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(TABLES))
    if name not in queries.SQL:  # tested by brute force elsewhere
        assert df.count() > 0
        return
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert ours == theirs

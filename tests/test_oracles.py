"""Every query against its SQL on the smallest tables."""

import os
import datetime
import decimal

import pytest

from sparkloom.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.sql(ORACLE_SQL[name])
    names = found.columns
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(str(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
    assert sorted(str(tuple(map(norm, r))) for r in rows) == want

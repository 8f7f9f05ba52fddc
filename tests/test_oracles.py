"""Every query with a SQL twin against DuckDB on the same tables."""

from datetime import datetime

import duckdb
import pytest

from tests.conftest import SMALL
from timberline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


SAME = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    found = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {catalog.ORACLES[name]}").fetchall()}
    found = con.execute(catalog.ORACLES[name])
    assert {c: SAME.get(types[c], types[c]) for c in columns} == dict(df.dtypes)
    assert sorted(columns) == sorted(df.columns)
    want = sorted([tuple(map(plain, r)) for r in found.fetchall()], key=str)
    got = sorted([tuple(map(plain, r)) for r in df.select(columns).collect()], key=str)
    assert got == want and len(got) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0

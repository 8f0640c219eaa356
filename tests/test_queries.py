"""Every query against its DuckDB equivalent on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from codeloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    cur = duck.execute(ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(kinds) == columns
    assert {k: v for k, v in kinds.items() if v in KINDS.values()} == {k: KINDS[t] for k, t in df.dtypes if t in KINDS}
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want

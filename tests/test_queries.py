"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from pixelloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if glob.os.path.isdir(path) else path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else (round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    ours = df.collect()
    result = duck.execute(registry.SQL[name])
    theirs = result.fetchall()
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    a, b = rows(df.columns, ours), rows(columns, theirs)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])

"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from recollect import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_integer_ratio"):
        return None if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in place) for r in got.fetchall())

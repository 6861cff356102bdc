"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from claimloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    mine = sorted([value(r[c]) for c in columns] for r in df.collect())
    places = [found.columns.index(c) for c in columns]
    theirs = sorted([value(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in places] for r in found.fetchall())
    numbers = [i for i, c in enumerate(columns) if dict(df.dtypes)[c] == "double"]
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert [x for i, x in enumerate(a) if i not in numbers] == [x for i, x in enumerate(b) if i not in numbers]
        assert [float(a[i] or "nan") for i in numbers] == pytest.approx([float(b[i] or "nan") for i in numbers], abs=2e-6, nan_ok=True)

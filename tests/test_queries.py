"""Every query that SQL can express gives the rows of its SQL over the smallest tables; the others give rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from gridloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def cell(v):
    if v is None or not hasattr(v, "__len__") and pd.isna(v):
        return ""
    if isinstance(v, float):
        return "0.0" if v == 0 else f"{v:.9g}" if math.isfinite(v) else str(v)
    return str(list(v)) if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and hasattr(v, "__len__") else str(v)


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(cell(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and not pd.isna(v) else v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.ORACLE_SQL:
        wanted = duck.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        a, b = rows(got), rows(wanted)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or all(p == q or abs(float(p) - float(q)) <= 2e-4 for p, q in zip(x, y, strict=True)), (x, y)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 400 and "weighted_wealth" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL must give the SQL's rows on the smallest tables."""
import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("HEADWAY_TESTDATA", "/root/testdata/sf0.001")


def tidy(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(tidy(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert got == want

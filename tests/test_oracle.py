"""Every archive query with SQL gives DuckDB's rows on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from talkarchive.plans import queries as plans

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(float(v)) else float(f"{float(v):.9g}")
    return str(v)


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, str(FOLDER))
    cursor = duck.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=str) == want

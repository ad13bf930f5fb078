"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, db, name):
    made = entry.queries()[name](spark, SF)
    told = db.sql(entry.oracle_sql()[name])
    assert canonical(made.columns, [tuple(r) for r in made.collect()]) == canonical(told.columns, told.fetchall())

"""Every query that SQL can express against its SQL in DuckDB on the smallest tables; the others are in test_brute.py."""

from __future__ import annotations

import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cohortwave.plans import registry

from .conftest import DATA


def one(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, numbers.Number):
        return round(float(v) + 0.0, 5)
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return str([one(x) for x in v])
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)

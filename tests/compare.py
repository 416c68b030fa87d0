"""Runs a registered query and its SQL on the same stored tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def agree(spark, name: str) -> int:
    """Asserts that both give the same rows; returns their number."""
    if not SMALL.exists():
        pytest.skip("the stored tables are not here")
    con = duckdb.connect()
    for f in SMALL.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = entry.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert got == want
    return len(got)

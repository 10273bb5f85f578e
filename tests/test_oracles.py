"""Every registered query against its SQL on the smallest tables, with the types that a comparison relies on."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from corpusloom import plans
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

plans.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want and (got or name in {"dangling_references", "near_duplicate_pairs"})

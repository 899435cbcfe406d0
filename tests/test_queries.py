"""Every registered query of the library itself against its SQL in DuckDB; rows only where there is no SQL."""

import math
import os

import duckdb
import pytest

from palimpsest.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert ours == theirs

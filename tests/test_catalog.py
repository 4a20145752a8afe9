"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from missivelake.plans import catalog

TABLES = "events documents embeddings conversations".split()
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want

"""Every registered query against its SQL on DuckDB, as multisets of rows."""

import math
from pathlib import Path

import pytest

from prefloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x + 0.0:.6g}" if isinstance(x, float) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want


FITS = (Path(__file__).parent / "test_fits.py").read_text()  # runs its queries itself


@pytest.mark.parametrize("name", sorted(n for n in set(registry.queries()) - set(registry.oracle_sql()) if f'"{n}"' not in FITS))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0

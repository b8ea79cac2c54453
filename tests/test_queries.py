"""Every catalogue query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from quarry.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        inside = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{inside}'")
    return c


def canonical(rows, columns):
    def cell(x):
        if x is None or x != x:
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x):.6g}" if abs(x) < 1e15 else str(x)
        return str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), got.columns)

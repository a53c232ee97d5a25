"""Every query against its SQL on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import registry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "" if pd.isna(x) else repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    want = db.execute(registry.oracle_sql()[name])
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert {c for c, _ in got.dtypes} == set(kinds)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
    assert {c: same.get(k, k) for c, k in got.dtypes} == kinds
    assert rows(got.toPandas()) == rows(want.fetchdf())

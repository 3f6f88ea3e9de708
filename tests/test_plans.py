import math

import duckdb
import pytest

from lexmill.registry import ORACLE_SQL, QUERIES
from lexmill.session import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def _plain(value):
    if value is None or value != value:
        return ""
    return f"{float(value):.6g}" if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_plan_matches_oracle(spark, oracle, name):
    ours, theirs = QUERIES[name](spark, FOLDER), oracle.sql(ORACLE_SQL[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert sorted(tuple(_plain(r[c]) for c in names) for r in ours.collect()) == sorted(tuple(_plain(dict(zip(theirs.columns, r, strict=True))[c]) for c in names) for r in theirs.fetchall())
    assert math.isfinite(len(names))

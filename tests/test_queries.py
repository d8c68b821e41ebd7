"""Every registered query against its SQL in an independent engine, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.compare import TABLES, normal  # noqa: E402

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="the tables are not here")
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{PATH}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, PATH)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        assert mine
        return
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == normal(result.fetchall(), columns)


def test_entry(spark):
    assert entry(spark).count() > 0

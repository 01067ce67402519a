"""The driver's contract over its smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
NAMES = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and v != v else v for v in row) for row in rows), key=repr)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).head(1)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    assert rows
    if name in __spark_entry__.oracle_sql():
        want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert plain(map(tuple, rows)) == plain(want)

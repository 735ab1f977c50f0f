"""The driver contract: every query runs at the smallest size, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fathomline import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in result.description].index(c) for c in cols]
    want = sorted(repr(plain(tuple(r[i] for i in at))) for r in result.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in df.select(cols).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_nothing_imports_the_llm_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/fathomline/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "fathomline.llm" not in f.read(), path

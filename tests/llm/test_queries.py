"""Every query of the problems runs at the smallest size; those with SQL equal it."""

import glob
import os

import duckdb
import pytest

from fathomline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLE:
        c = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        result = c.execute(queries.ORACLE[name])
        at = [[x[0] for x in result.description].index(k) for k in df.columns]
        assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())

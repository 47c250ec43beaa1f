"""Every query against its SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

from contigra.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(frame, cols):
    d = frame[cols].astype(object)
    return sorted(map(repr, d.where(d.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got, cols) == plain(want, cols)

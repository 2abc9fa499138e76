"""Every core query with an SQL twin gives its rows, on the smallest tables."""

from pathlib import Path

import pytest

from fairloom.plans import catalogue
from tools.compare import canon

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    got = sorted(tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = con.execute(catalogue.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(canon(row[i]) for i in order) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    df.collect()

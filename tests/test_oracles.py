"""Every query of the library against its DuckDB SQL, at the smallest scale; the others must run and give rows."""

import os

import duckdb
import pytest

from quire.plans import registry

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


def rows(table, columns):
    return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in columns], strict=True)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    want = duck.execute(sql).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows(got, columns) == rows(want, columns)


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())

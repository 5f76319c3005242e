import duckdb
import pytest

from leafspring.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    assert rows
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == names
        want = rel.project(", ".join(f'"{n}"' for n in names)).fetchall()
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))

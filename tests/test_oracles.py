"""Every query's SQL can be planned by DuckDB over the test tables, and gives the columns that the query gives."""

from pathlib import Path

import pytest

from papyrine.plans import registry

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_is_planned(tables, name):
    assert name in registry.queries()
    tables.execute(f"EXPLAIN {registry.oracle_sql()[name]}")


@pytest.mark.parametrize("name", ["TXT-08", "TXT-09", "WN-10"])
def test_columns(spark, tables, name):
    made = tables.execute(f"SELECT * FROM ({registry.oracle_sql()[name]}) LIMIT 0")
    assert sorted(c[0] for c in made.description) == sorted(registry.queries()[name](spark, str(FOLDER)).columns)

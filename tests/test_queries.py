"""Every registered query of the citation engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from juriscope.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        found.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = con.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    rows = lambda df: sorted(str([plain(x) for x in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

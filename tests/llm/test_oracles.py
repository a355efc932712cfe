"""The SQL oracles of the registered queries, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from juriscope.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    rows = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_all_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}

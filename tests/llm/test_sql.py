"""The corpus queries that SQL can express against DuckDB."""

import duckdb
import pytest

from typoforge.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    order = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert order(got) == order(want)

"""Queries with SQL give what DuckDB gives on the same tables."""

import duckdb
import pandas as pd
import pytest

from plumeria.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = "page_id" if name == "op4_warc" else "doc_id"
    got, want = (df.sort_values(key).reset_index(drop=True)[sorted(want.columns)] for df in (got, want))
    plain = lambda s: [None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 6) for x in s]
    for column in want.columns:
        for x, y in zip(plain(got[column]), plain(want[column]), strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-9), column

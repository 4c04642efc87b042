"""Every query of the cell engine against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from cellstrata import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def _rows(df):
    cols = sorted(df.columns)
    return Counter(tuple(None if v is None or v != v else v for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    expected = con.sql(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)

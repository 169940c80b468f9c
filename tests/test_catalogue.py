"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodeseek.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert _rows(got) == _rows(con.execute(catalogue.ORACLE[name]).df())

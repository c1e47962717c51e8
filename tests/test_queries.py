"""Every registered query of the derived facts against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from symtrail import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def rows(pdf):
    columns = sorted(pdf.columns)
    clean = pdf.astype(object).where(pdf.notna(), None)[columns]
    return columns, sorted(map(str, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_every_query_without_sql_has_rows(spark):
    for name in ("fts_bm25", "rate_limit", "resolve_java"):
        assert catalog.queries()[name](spark, SF).count() > 0

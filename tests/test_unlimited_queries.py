"""Queries that take every file and every hit."""

import os

import pytest

from symtrail import catalog
from symtrail.plans.adapters import star_facts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_file_is_ranked(spark):
    files = {r["file"] for r in star_facts(spark, SF).symbols.select("file").distinct().collect()}
    got = catalog.queries()["rank_per_file"](spark, SF).collect()
    assert len(files) > 10 and {r["file"] for r in got} == files


def test_prefix_search_has_no_limit(spark):
    found = catalog.queries()["fts_prefix"](spark, SF)
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()

"""The analysis of every stack trace, against plain Python, on events with large ids."""

import os
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from symtrail import catalog
from symtrail.plans.adapters import star_facts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_trace_is_analysed(spark, tmp_path):
    for name in ("part", "lineitem", "customer", "nation"):
        source = f"{SF}/{name}.parquet"
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / f"{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") * 7 + 1)
    events.write.parquet(str(tmp_path / "events.parquet"))
    errors = [r["event_id"] for r in events.filter("event_type = 'error'").select("event_id").collect()]
    assert max(errors) >= 2000 > min(errors)

    f = star_facts(spark, str(tmp_path))
    symbols, refs = sorted(f.symbols.collect(), key=lambda s: s["id"]), f.refs.collect()
    by_id, short = {s["id"]: s["qualified"] for s in symbols}, {}
    for s in symbols:
        short.setdefault(s["qualified"], s["name"])
    holders = defaultdict(set)
    for r in refs:
        above = [(s["line"], s["id"], s["qualified"]) for s in symbols if s["file"] == r["file"] and s["kind"] in ("function", "member") and s["line"] <= r["line"]]
        if above:
            holders[r["name"].split(".")[-1]].add(max(above)[2])
    want = []
    for event in errors:
        if event % len(symbols) in by_id:
            symbol = by_id[event % len(symbols)]
            want.append((event, symbol, symbol, len(holders[short[symbol]] - {symbol})))
    got = [tuple(r) for r in catalog.queries()["analyze_stacktrace"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)

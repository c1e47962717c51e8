"""Surrogates that grow until they are distinct, or an error."""

import pytest
from pyspark.sql import functions as F

from symtrail.llm import pii

PARTS = "kind_ string, gender_ string, entity_ string"


def test_entities_of_few_surrogates_get_longer_ones(spark, monkeypatch):
    """Each first length is cut to one value, so that only longer surrogates are distinct."""
    real = pii.surrogate

    def narrow(key, kind, gender, attempt):
        drawn = real(key, kind, gender, attempt)
        shortest = real(key, kind, gender, F.lit(0))
        return F.when(F.char_length(drawn) <= F.char_length(shortest), F.concat(F.lit("s"), kind)).otherwise(drawn)

    monkeypatch.setattr(pii, "surrogate", narrow)
    rows = [("name", "", f"Ada{c}") for c in "bcdefgh"] + [("name", "", f"Ли{c}") for c in "абв"] + [("email", "", f"{c}@b.co") for c in "abcd"]
    made = pii.dictionary(spark.createDataFrame(rows, PARTS)).collect()
    assert len({(r["kind_"], r["surrogate_"]) for r in made}) == len(made) == len(rows)


def test_what_cannot_be_distinct_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, gender, attempt: F.lit("same"))
    monkeypatch.setattr(pii, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="not distinct"):
        pii.dictionary(spark.createDataFrame([("ip", "", "10.0.0.1"), ("ip", "", "10.0.0.2")], PARTS))

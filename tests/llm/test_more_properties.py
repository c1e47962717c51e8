"""Seeds of short items, quality thresholds, account numbers, and filters that are not sent."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtrail.llm import decontaminate, licenses, line_dedup, pii, quality


@pytest.mark.parametrize("n", range(5, 21))
def test_no_placement_of_replaced_words_hides_an_item(n):
    """Each item of n words with as many replaced as may be, in every placement, keeps a seed."""
    masks = [m for m, least, most in decontaminate._masks([n] if n < 20 else [], decontaminate.MASKS, 20) if least <= n <= most]
    replaced = n - -(-n * 8 // 10)
    for gone in itertools.combinations(range(n), replaced):
        assert any(not {at + i for i in mask} & set(gone) for mask in masks for at in range(n - mask[-1])), gone


def test_threshold_is_the_quantile_of_rejected_rows():
    raw = np.array([0.5, -1.0, 2.0, 0.1, 3.0])
    assert quality._threshold(raw, 2) == pytest.approx(0.3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    label = (x[:, 0] > 0.3).astype(int)
    scores = quality.fit(x, label, pairs=5000).scores(x)
    assert (scores < 0.5).sum() == (label == 0).sum() and ((scores >= 0.5) == label).mean() > 0.97


def test_account_numbers_keep_right_check_digits(spark):
    known = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"]
    wrong = "DE00370400440532013000"

    def rest(text):
        bare = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97

    docs = spark.createDataFrame([(i, f"pay to {x} now") for i, x in enumerate([*known, wrong])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k").collect()}
    for i, x in enumerate(known):
        new = got[i]["text"].removeprefix("pay to ").removesuffix(" now")
        assert rest(x) == 1 == rest(new) and new != x and new[:2] == x[:2]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in x] and got[i]["kinds"] == ["iban"]
    assert got[3]["text"] != f"pay to {wrong} now"
    assert {r["text"] for r in pii.pseudonymised(docs, "another").collect()}.isdisjoint(r["text"] for r in got.values())


def test_filters_meet_their_shards_when_too_large_to_send(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"Line number {i} of the pool" for i in range(300)]
    rows = [(f"d{d:03d}", "\n".join([*(rng.choice(pool) for _ in range(6)), f"only document {d} has this"])) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    sent = line_dedup.line_dedup(docs).select("doc_id", "n_dropped", F.sha2("kept_text", 256)).collect()
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)  # many shards
    state = line_dedup._state_of(docs, 10, 4)
    assert state.shards > 4 and state.filters.count() > 4
    refs = line_dedup._refs_of(docs, 10, state.shards).select("hi", "lo", "doc_id")
    passed = line_dedup._sifted(refs, state.filters.withColumn("shards", F.lit(state.shards)))
    repeated = refs.join(state.counts.select("hi", "lo"), ["hi", "lo"], "left_semi")
    assert repeated.exceptAll(passed).count() == 0 and passed.count() < repeated.count() + 20 < refs.count()
    met = line_dedup.line_dedup(docs, filter_bytes=0).select("doc_id", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert sorted(sent) == sorted(met)
    with pytest.raises(ValueError):
        line_dedup.build(docs, shards=3)


def test_whole_licence_texts(spark):
    """Each text is found as it stands, with a word changed in every twenty-five, and not by its first half."""
    rows = []
    for i, text in enumerate(licenses.TEXTS.values()):
        words = text.split()
        worn = [f"w{k}" if k % 25 == 7 else w for k, w in enumerate(words)]
        rows += [(10 * i, f"intro words {text} and more"), (10 * i + 1, " ".join(worn)), (10 * i + 2, " ".join(words[: len(words) // 2]))]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(licenses.TEXTS):
        assert label in got[10 * i] and label in got[10 * i + 1] and label not in got[10 * i + 2]

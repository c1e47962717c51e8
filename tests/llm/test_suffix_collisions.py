"""Suffix-array dedup where rolling hashes collide, and where one passage stands in many documents."""

import collections
import random

from symtrail.llm import suffix_dedup


def test_strings_whose_rolling_hashes_collide_stay(spark):
    word = "P"
    while len(word) < 256:
        word += word.translate(str.maketrans("PV", "VP"))
    other = word.translate(str.maketrans("PV", "VP"))
    rng = random.Random(1)
    amid = "".join(rng.choice("abcdefghijklmnop") for _ in range(128))
    rows = [(1, word + amid + other), (2, other + amid + word)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 640, 0, 0), (2, 640, 0, 0)]


def test_a_passage_in_many_texts(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    passage = some(700)
    rows = []
    for d in range(300):
        a, b = rng.randrange(0, 250), rng.randrange(450, 700)
        rows.append((str(d), some(rng.randrange(500)) + "#" + passage[a:b] + "#" + some(rng.randrange(500))))
    seen = collections.Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for d, t in rows:
        gone = {i + k for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1 for k in range(400)}
        assert (got[d]["n_bytes"], got[d]["n_removed"]) == (len(t), len(gone))
        assert bytes(got[d]["kept"]).decode() == "".join(c for i, c in enumerate(t) if i not in gone)


def test_widths():
    assert suffix_dedup._widths(400, 128, 4) == [64, 16, 4, 1] and suffix_dedup._widths(40, 12, 1024) == [1]

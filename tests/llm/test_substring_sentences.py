"""Substring dedup of passages amid longer lines, against brute force over sentences."""

import random

from symtrail.llm import substring_dedup


def sentences(text):
    return [x for line in text.split("\n") for x in line.replace(". ", ".\0").split("\0") if x]


def brute(rows, least):
    """The sentences that stay, by every run of sentences with `least` words that an earlier place holds."""
    runs, lost = {}, {d: set() for d, _ in rows}
    for d, text in sorted(rows):
        own = sentences(text)
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                run = " ".join(own[i:j]).lower().replace(".", "")
                if len(run.split()) >= least and runs.setdefault(run, (d, i, j)) != (d, i, j):
                    o, _, end = runs[run]
                    lost[d].update(range(max(i, end) if o == d else i, j))
    return {d: [x for i, x in enumerate(sentences(text)) if i not in lost[d]] for d, text in rows}


def test_sentences_amid_lines(spark):
    rng = random.Random(6)
    pool = [" ".join(f"w{i}x{k}" for k in range(rng.randrange(1, 9))).capitalize() + "." for i in range(90)]
    passages = [rng.sample(pool, rng.randrange(2, 7)) for _ in range(8)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 4)):
            own += rng.sample(pool, rng.randrange(3)) + rng.choice(passages)
        rows.append((d, "".join(x + rng.choice("  \n") for x in own).strip()))
    for ids, kind in ((lambda d: d, "long"), (lambda d: f"{d:03d}", "string")):
        docs = spark.createDataFrame([(ids(d), t) for d, t in rows], f"doc_id {kind}, text string").repartition(3)
        got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, min_words=12).collect()}
        want = brute(rows, 12)
        assert {d: sentences(r["kept_text"]) for d, r in got.items()} == {ids(d): w for d, w in want.items()}
        for d, t in rows:
            spans, kept, at = got[ids(d)]["spans"], "", 0
            for s in spans:
                kept, at = kept + t[at : s["start"]], s["end"]
            assert kept + t[at:] == got[ids(d)]["kept_text"]


def test_a_line_keeps_its_break_and_rows_of_one_id_their_own_places(spark):
    passage = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, passage), (2, f"Mine. {passage}\nNext"), (3, f"{passage}\nOther"), (4, f"aa {passage}"), (4, f"Yes. {passage}"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["kept_text"] for r in substring_dedup.substring_dedup(docs).collect())
    assert got == sorted([passage, "Mine. \nNext", "Other", f"aa {passage}", "Yes. ", passage])
    fewer = substring_dedup.substring_dedup(docs, losers_only=True).collect()
    assert sorted(r["doc_id"] for r in fewer) == [2, 3, 4]


def test_frequent_units_go_without_a_shuffle(spark, monkeypatch):
    from symtrail.llm import common

    hot = " ".join(f"hot{i}" for i in range(31))
    rows = [(d, f"{hot}\nown text {d}" if d % 3 else f"other {d}") for d in range(2000)]
    found = common.frequent(spark.createDataFrame([(d % 3,) for d in range(4000)], "k long"), "k")
    assert {r["k"] for r in found.collect()} == {0, 1, 2}
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), losers_only=True).collect()
    assert {r["doc_id"] for r in got} == {d for d in range(2, 2000) if d % 3}
    assert all(r["keep_doc_ids"] == [1] and r["kept_text"] == f"own text {r['doc_id']}" for r in got)

"""Substring dedup of passages set as short lines, against brute force."""

import random

from symtrail.llm import substring_dedup

DOCS = "doc_id long, text string"


def brute(rows, least):
    """The lines that stay, by every run of lines with `least` words that an earlier place holds."""
    runs, lost = {}, {d: set() for d, _ in rows}
    for d, text in sorted(rows):
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = " ".join(lines[i:j]).lower()
                if len(run.split()) >= least and runs.setdefault(run, (d, i, j)) != (d, i, j):
                    o, _, end = runs[run]
                    lost[d].update(range(max(i, end) if o == d else i, j))
    return {d: [x for i, x in enumerate(text.split("\n")) if i not in lost[d]] for d, text in rows}


def test_runs_of_short_lines(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{i}x{k}" for k in range(rng.randrange(1, 9))) for i in range(60)]
    passages = [rng.sample(pool, rng.randrange(2, 7)) for _ in range(8)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += rng.sample(pool, rng.randrange(3)) + rng.choice(passages)
        rows.append((d, "\n".join(lines)))
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS).repartition(3), min_words=12).collect()}
    want = brute(rows, 12)
    assert {d: [x for x in r["kept_text"].split("\n") if x] for d, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values()) == sum(t.count("\n") + 1 for _, t in rows) - sum(map(len, want.values())) > 50


def test_query_takes_short_lines_and_reset_paragraphs(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    verse = "\n".join(" ".join(words[i : i + 6]) for i in range(0, 60, 6))
    rows = [
        (1, f"own start\n\n{verse}\n\nown end"), (2, f"another start\n{verse.upper()}\nanother end"),  # lines of six words
        (3, "new text\n\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(60) if i % 9 == 0) + "\n\nlast"),  # the same with other line breaks
        (4, f"first\n\n{verse}\n\nfinal"), (5, "\n".join(words[:6])), (6, " ".join(words[:6])),  # a short repeat stays
    ]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in substring_dedup.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2]["n_removed"] == 10 and [tuple(s) for s in got[2]["spans"]] == [(14, 14 + len(verse) + 1)] and got[2]["keep_doc_ids"] == [1]
    assert got[3]["n_removed"] == 7 and got[4]["n_removed"] == 10


def test_a_repeat_that_overlaps_itself_keeps_its_first_run(spark):
    rows = [(1, "\n".join(["la la la"] * 9))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS), min_words=12).first()
    assert got["kept_text"].split("\n")[:4] == ["la la la"] * 4 and got["n_removed"] == 5

"""The pipeline's rows against the same stages in plain Python, one after the other."""

import random

import numpy as np
import pytest
from test_llm_operators import brute_components, brute_fingerprint, brute_leaks, brute_lines, sha

from symtrail.llm import bpe, quality


def test_pipeline_equals_plain_python(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline

    rng = random.Random(21)
    prose = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(999)}" for _ in range(n)).capitalize() + "."
    pool, leaks = [prose(12) for _ in range(6)], [prose(25) for _ in range(3)]
    rows = []
    for i in range(160):
        text = "BUY!! NOW!! " * 30 if i % 5 == 0 else "\n".join(rng.sample([prose(40), prose(30), rng.choice(pool), *([rng.choice(leaks)] if i % 7 == 0 else [])], 3))
        rows.append((i, text))
    rows += [(200 + i, rows[3 * i + 1][1] + rng.choice(["", " Zz."])) for i in range(20)] + [(300, None), (301, "")]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 160, 2)]
    items = list(enumerate(leaks))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    left = [(d, t) for d, t in rows if model.scores(np.array([quality.features(t)]))[0] >= 0.5]
    assert 0 < len(rows) - len(left) < 60
    left = [(d, t) for d, t, _, _ in brute_lines(left)]
    prints = {d: brute_fingerprint(t) for d, t in left}
    group = brute_components(sorted(set(prints.values())))
    least = {}
    for d, p in prints.items():
        least[group[p]] = min(d, least.get(group[p], d))
    single = [(d, t) for d, t in left if least[group[prints[d]]] == d]
    assert len(single) < len(left)
    leaked = {d for d, _ in brute_leaks(single, items)}
    assert leaked
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for d, t in single:
        if d not in leaked:
            ids = theirs.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)), ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()
    assert sorted(map(tuple, got)) == sorted(want)

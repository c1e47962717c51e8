"""The quality model on labelled rows that it has not seen, and its loss against plain gradient steps."""

import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from symtrail.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_labels():
    labels = dict(zip(*(pq.read_table(f"{SF}/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")), strict=True))
    docs = pq.read_table(f"{SF}/documents.parquet")
    x, y, held = [], [], []
    for d, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        if d in labels:
            x.append(quality.features(t))
            y.append(labels[d])
            held.append(zlib.crc32(str(d).encode()) % 3 == 1)
    x, y, held = np.array(x), np.array(y), np.array(held)
    scores = quality.fit(x[~held], y[~held]).scores(x[held])
    good, bad = scores[y[held] == 1], scores[y[held] == 0]
    ranked = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert len(good) > 20 and len(bad) > 10 and ranked > 0.95
    assert ((scores >= 0.5) == (y[held] == 1)).mean() > 0.9


def test_weights_minimise_the_pairwise_loss():
    rng = np.random.default_rng(3)
    d = rng.normal(size=(500, 6)) + [0.5, 0, -0.3, 0, 0, 1]
    found, slow = quality._logistic(d), np.zeros(6)
    for _ in range(20_000):  # steps down the same loss
        p = 1 / (1 + np.exp(d @ slow))
        slow += 0.002 * (d.T @ p - slow)
    assert np.allclose(found, slow, atol=1e-4)

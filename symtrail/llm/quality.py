"""Quality classifier by Bradley-Terry pairwise ranking.

The chance that document a is preferred to b is the logistic function of the difference of their
scores, which are linear in features of the text. Preference pairs put each accepted document of a
bounded sample before rejected ones; logistic loss on feature differences gives the weights, and the
threshold is a quantile of the sample's scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped, sliced, table

#: The model is fitted on at most this many labelled rows, drawn by a hash of doc_id, and this many
#: preference pairs. Scoring covers all rows and whole texts.
SAMPLE, PAIRS = 20_000, 200_000

FEATURES = (
    "log_words", "log_chars", "short", "word_length", "long_words", "upper", "digits", "stops", "marks", "symbols", "bars",
    "exclaims", "spaces", "distinct_words", "top_word", "same_as_last", "distinct_lines", "log_lines", "line_words",
    "ended_lines", "distinct_bigrams", "lower_starts", "distinct_rate", "odd_bytes",
)
_SYMBOL = bytes(b"#$%&*<=>@[]\\^_`{|}~+/")
_CLASS = np.zeros(256, np.int64)
for _value, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?", b",;:'\"()-", _SYMBOL.replace(b"|", b""), b"|", b"!", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_members)] = _value
_CLASS[[b for b in range(32) if b not in (9, 10, 11, 12, 13)]] = 9
_CLASS[128:] = 10


def features(text: str | None) -> list[float]:
    """Of the whole text; an empty one has zeros and ones that say so."""
    data = (text or "").encode()
    words = data.lower().split()
    n, size = len(words), max(1, len(data))
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=11) / size
    ids: dict[bytes, int] = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    pairs = len(np.unique(numbers[:-1] * (n + 1) + numbers[1:])) if n > 1 else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = np.bincount(numbers).max() if n else 0
    k = max(1, n)
    return [
        np.log1p(n), np.log1p(len(data)), float(n < 20), lengths.mean() if n else 0.0, float((lengths > 25).mean()) if n else 0.0,
        counts[1], counts[2], counts[3], counts[4], counts[5], counts[6], counts[7], counts[8],
        len(ids) / k, top / k, float((numbers[1:] == numbers[:-1]).sum()) / k,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / max(1, len(lines)),
        pairs / max(1, n - 1), sum(x.lstrip()[:1].islower() for x in lines) / max(1, len(lines)),
        np.log(len(ids) + 1) / np.log(n + 2), counts[9],
    ]


class Model(NamedTuple):
    """score = logistic(sharpness * (weights . ((x - centre) / width, squared as well) - threshold))."""

    centre: np.ndarray
    width: np.ndarray
    weights: np.ndarray
    threshold: float
    sharpness: float

    def expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.width, -6, 6)
        return np.concatenate([z, z * z / 6], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.sharpness * (self.expanded(x) @ self.weights - self.threshold)
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def _logistic(d: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the logistic loss of d @ w being positive, with a ridge."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # the chance given to the wrong side
        grad = d.T @ p - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _threshold(raw: np.ndarray, rejected: int) -> float:
    """The quantile of the scores at the share of rejected rows: midway between the last score that
    falls below it and the first that does not."""
    order = np.sort(raw)
    return float((order[rejected - 1] + order[rejected]) / 2)


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Bradley-Terry weights from preference pairs; the threshold is the quantile of the sample's
    scores at the share of rejected labels.

    With labels of one kind only nothing can be ranked: every score is then that kind's, 1 or 0
    (1 with no labels at all).
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label != 1)
    dims = len(FEATURES)
    if not len(good) or not len(bad):
        return Model(np.zeros(dims), np.ones(dims), np.zeros(2 * dims), -1.0 if len(good) or not len(bad) else 1.0, 20.0)
    centre, width = np.median(x, axis=0), x.std(axis=0)
    model = Model(centre, np.where(width > 1e-9, width, 1.0), np.zeros(2 * dims), 0.0, 1.0)
    z = model.expanded(x)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    weights = _logistic(z[a] - z[b])
    raw = z @ weights
    return model._replace(weights=weights, threshold=_threshold(raw, len(bad)))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and x, an array of features, for each row."""

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            x = [features(t) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.record_batch([batch.column(names.index("doc_id")), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return shipped(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> Model:
    """A model from rows whose fold is not 1. Of the labelled rows at most `sample`, those with the
    least hashes, are looked up among the documents; so a broadcast of `sample` rows finds them, and
    no text is shuffled. Labels that are null or conflict within a doc_id don't count."""
    usable = labels.filter((fold(F.col("doc_id")) != 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    usable = usable.filter("quality = most").select("doc_id", F.col("quality").alias("label_"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    known = with_features(found).join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "label_").orderBy("doc_id", "x").limit(sample).toPandas()
    x = np.array(known["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, known["label_"].to_numpy(), pairs)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row of docs, by the text alone. No shuffle.

    Null and empty texts are scored as well. Repeated rows give repeated results; null doc_ids are
    rows like any other; columns other than doc_id and text are ignored.
    """

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            score = model.scores(x)
            yield pa.record_batch([batch.column(names.index("doc_id")), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return shipped(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the model predicts to be accepted."""
    model = train(docs, labels)
    schema = docs.schema

    def rows(batches):
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return shipped(docs).mapInArrow(rows, schema)


def op3_quality_classifier(spark, sf_dir):
    """Every document with its score; held out where its fold is 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")

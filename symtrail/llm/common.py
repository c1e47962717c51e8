"""What the corpus operators share: reading, shared scratch space, skew-proof lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from ..shipping import ship

__all__ = ["HOT_KEYS", "ascii_lower", "cut", "frequent", "lookup", "materialise", "shipped", "sliced", "table", "whole_text"]

#: At most this many keys of a table are broadcast as its hot keys.
HOT_KEYS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """df, once this package's sources are on their way to the executors that will run its Python."""
    ship(df.sparkSession)
    return df


def whole_text(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that, and much faster, when all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def frequent(rows: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """Values of key that may stand in `least` rows or more, HOT_KEYS of them at most.

    One pass of a frequent-items sketch with a fixed number of counters: every value with more than
    one in 16,384 of the rows is among them; of rarer ones none need be.
    """
    sketch = rows.agg(F.expr(f"approx_top_k({key}, {HOT_KEYS}, 16384)").alias("items"))
    return materialise(sketch.select(F.explode("items").alias("x")).filter(F.col("x.count") >= least).select(F.col("x.item").alias(key)))


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, how: str = "inner", sift: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows joined to keyed, which has one row a key and the number of rows of each key in `weight`.

    The HOT_KEYS heaviest keys at most, a bound that no input changes, are broadcast; the rows of
    all other keys are shuffled. Such a key has at most one in HOT_KEYS of the rows, so no task gets
    the rows of a hot key, and nothing is dropped. how: inner or left. sift, with inner, may take
    rows out that have no key in keyed before they are shuffled.
    """
    hot = keyed.filter(F.col(weight) >= 1000).orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = materialise(hot)
    rest = keyed.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    mark = hot.withColumn("is_hot_", F.lit(True))
    joined = rows.join(F.broadcast(mark), keys, "left")
    near = joined.filter("is_hot_").drop("is_hot_")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    far = (cold if sift is None else sift(cold)).join(rest, keys, how)
    return near.unionByName(far.select(*near.columns))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """data without the spans, which may overlap; bytes removed; maximal removed runs."""
    kept, at, removed, runs, last = [], 0, 0, 0, -1
    for start, end in sorted(spans):
        start, end = max(start, at), min(end, len(data))
        if end <= start:
            continue
        kept.append(data[at:start])
        runs += start > last or last < 0
        removed += end - start
        at = last = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs

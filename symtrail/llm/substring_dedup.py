"""Substring dedup by line and paragraph hashing, with the removed spans' original offsets.

A short unit is hashed with its neighbours: what is compared are the shortest runs of units that
reach the word minimum, one from each unit on and one up to each unit. So all units of a repeated
run that reaches it together go, however short each is. Units are sentences (so that a passage
amid a longer line is found), lines, or paragraphs.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frequent, materialise, shipped, sliced, table

#: A repeat goes if it has this many words, in as many neighbouring units as it takes.
MIN_WORDS = 30
_BREAK = {"sentence": re.compile(r"\n|(?<=[.!?])[^\S\n]+|(?<=[。！？])"), "line": re.compile("\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}


def units(text: str, unit: str):
    """(start, end) of each sentence, line or paragraph, in characters, without what separates them."""
    at = 0
    for m in _BREAK[unit].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def normalised(text: str) -> str:
    """What must agree for two units to be one: NFKC, lower case, words only, single spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(re.findall(r"\w+", text.lower()))


def candidates(text: str, unit: str, min_words: int):
    """(start, end, normalised text) of what is compared: each paragraph of min_words words or more,
    or the shortest runs of sentences or lines that have as many; with unit all, paragraphs and
    runs of sentences.

    Units without words take no part and do not end a run. Of any run of units that has min_words
    words, every unit lies in a candidate inside the run.
    """
    if unit == "paragraph":
        for start, end in units(text, unit):
            key = normalised(text[start:end]) if end > start else ""
            if key and key.count(" ") >= min_words - 1:
                yield start, end, key
        return
    least = max(min_words, 1)
    spans, keys, sizes, blocks, block = [], [], [], [], 0
    for start, end in units(text, "sentence" if unit == "all" else unit):
        key = normalised(text[start:end]) if end > start else ""
        if key:
            spans.append((start, end))
            keys.append(key)
            sizes.append(key.count(" ") + 1)
            blocks.append(block)
        elif not text[start:end].strip() and text[start - 1 : start] in ("", "\n") and text[end : end + 1] in ("", "\n"):
            block += 1  # a blank line
    n, runs = len(keys), set()
    to, total = 0, 0
    for at in range(n):
        while to < n and total < least:
            total += sizes[to]
            to += 1
        if total < least:
            break
        runs.add((at, to))
        total -= sizes[at]
    at, total = 0, 0
    for to in range(n):
        total += sizes[to]
        while total - sizes[at] >= least:
            total -= sizes[at]
            at += 1
        if total >= least:
            runs.add((at, to + 1))
    if unit == "all":
        at = 0
        for to in range(1, n + 1):
            if to == n or blocks[to] != blocks[at]:
                if sum(sizes[at:to]) >= least:
                    runs.add((at, to))
                at = to
    for at, to in sorted(runs):
        yield spans[at][0], spans[to - 1][1], " ".join(keys[at:to])


def _units_of(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """hi, lo (the digest), doc_id, tag (of the text, as rows may share a doc_id), start, end."""
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            of, digest, starts, ends = [], [], [], []
            for row, text in enumerate(batch.column(names.index("text")).to_pylist()):
                for start, end, key in candidates(text or "", unit, min_words):
                    of.append(row)
                    digest.append(xxhash.xxh3_128_digest(key))
                    starts.append(start)
                    ends.append(end)
            pairs = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            owner, tag = (batch.column(names.index(n)).take(pa.array(of, pa.int64())) for n in ("doc_id", "tag"))
            yield pa.record_batch([pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 0].copy()), owner, tag, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["hi", "lo", "doc_id", "tag", "start", "end"])

    return shipped(docs).filter("doc_id is not null").select("doc_id", F.hash("text").alias("tag"), "text").mapInArrow(rows, f"hi long, lo long, doc_id {kind}, tag int, start long, end long")


def duplicate_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag, start, end, keep_doc_id, keep_start for every unit that goes.

    Of units with equal normalised text over all documents the earliest stays, by (doc_id, start);
    what is in no unit of min_words words that repeats always stays. Units are candidates(), which may
    overlap; of one that overlaps the one that stays, the rest goes. Rows that share a doc_id and agree
    in a unit's place count as one. A row with a null doc_id takes no part. doc_ids of any type that
    has an order will do.

    The texts are read once. Digests that a sketch finds frequent (a bounded number) get their first
    place by an aggregate with map-side partials and a broadcast, and their rows are salted, so no task
    has all rows of one; for all others a window of each digest in order carries the first place on.
    """
    every = materialise(_units_of(docs, unit, min_words))
    hot = frequent(every, "hi")
    place = F.struct("doc_id", "start", "end")
    mark = every.join(F.broadcast(hot.withColumn("is_hot_", F.lit(True))), "hi", "left")
    kept = lambda c: F.when(F.col("is_hot_"), F.col(c)).alias(c)  # noqa: E731  (all other rows are one group, of null, that joins nothing)
    firsts = materialise(mark.groupBy(kept("hi"), kept("lo")).agg(F.min(place).alias("hot_")))
    marked = every.join(F.broadcast(firsts), ["hi", "lo"], "left")
    salt = F.when(F.isnull("hot_"), F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id", "start"))
    along = Window.partitionBy("hi", "lo", salt).orderBy("doc_id", "start").rowsBetween(Window.unboundedPreceding, 0)
    gone = marked.withColumn("first", F.coalesce("hot_", F.first(place).over(along))).filter("first.doc_id <> doc_id or first.start <> start")
    after = F.when(F.col("first.doc_id") == F.col("doc_id"), F.greatest("start", "first.end")).otherwise(F.col("start"))
    return gone.withColumn("start", after).filter("start < end").select("doc_id", "tag", "start", "end", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"))


def _units_within(text: str, gone: list[tuple[int, int]], unit: str):
    """The units of the text that lie in one of the spans, sorted by start."""
    merged = []
    for start, end in sorted(gone):
        if merged and start <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    at = 0
    for start, end in units(text, unit):
        while at < len(merged) and merged[at][1] < end:
            at += 1
        if at == len(merged):
            return
        if merged[at][0] <= start:
            yield start, end


def _without(text: str, lost: list[tuple[int, int]], breaks: re.Pattern):
    """The text without the units in lost (sorted), and the spans that go. What separates a unit
    from the next goes with it, but a line break stays where something before it in its line does."""
    spans, parts, at = [], [], 0
    for start, end in lost:
        if start > at:
            parts.append(text[at:start])
        stop = breaks.match(text, end)
        stop = stop.end() if stop and (stop.group() != "\n" or not parts or parts[-1].endswith("\n")) else end
        if spans and spans[-1]["end"] == start:
            spans[-1]["end"] = stop
        else:
            spans.append({"start": start, "end": stop})
        at = stop
    return "".join(parts) + text[at:], spans


def substring_dedup(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, losers_only: bool = False) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, spans, keep_doc_ids, kept_text: each document without its
    repeats; losers_only: only those that lose something. keep_doc_ids are the documents with the
    earliest of each unit that goes, sorted; where units overlap, such a document may lose part of its
    own to a still earlier one. n_units and n_removed count sentences, lines or paragraphs (with unit
    all, sentences), also those without words amid a run that goes.

    spans are (start, end) in characters of the original text, so that it can be restored. Null and
    empty texts are one empty unit and stay as they are (kept_text is then empty). Every row gives a
    row, also one with a null doc_id (nothing removed). Rows that share a doc_id but not the text
    lose what is theirs. Other columns are ignored. An empty table gives an empty result.
    """
    gone = duplicate_units(docs, unit, min_words).groupBy(F.col("doc_id").alias("key_"), F.col("tag").alias("tag_"))
    gone = gone.agg(F.collect_set(F.struct("start", "end")).alias("gone_"), F.sort_array(F.collect_set("keep_doc_id")).alias("keep_doc_ids"))
    whole = docs.select("doc_id", "text")
    unit = "sentence" if unit == "all" else unit
    breaks = _BREAK[unit]
    named = whole.filter("doc_id is not null")
    marked = named.join(gone, (named["doc_id"] == gone["key_"]) & (F.hash(named["text"]) == gone["tag_"]), "inner" if losers_only else "left").drop("key_", "tag_")
    if not losers_only:
        marked = marked.unionByName(whole.filter("doc_id is null"), allowMissingColumns=True)

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            n_units, removed, spans_of, kept = [], [], [], []
            for text, gone in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("gone_")).to_pylist(), strict=True):
                text = text or ""
                lost = sorted({(x["start"], x["end"]) for x in gone or ()})
                if unit != "paragraph":
                    lost = list(_units_within(text, lost, unit))
                rest, spans = _without(text, lost, breaks)
                n_units.append(1 + sum(1 for _ in breaks.finditer(text)))
                removed.append(len(lost))
                spans_of.append(spans)
                kept.append(rest)
            holders = batch.column(names.index("keep_doc_ids"))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(names.index("doc_id")), pa.array(n_units, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans_of], pa.int64()), pa.array(spans_of, span), holders, pa.array(kept, pa.string())], names=["doc_id", "n_units", "n_removed", "n_spans", "spans", "keep_doc_ids", "kept_text"])

    kind = dict(docs.dtypes)["doc_id"]
    return marked.mapInArrow(rows, f"doc_id {kind}, n_units long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, keep_doc_ids array<{kind}>, kept_text string")


def op1_substring_dedup(spark, sf_dir):
    """The documents that lose something; all others stay as they are."""
    out = substring_dedup(table(spark, sf_dir, "documents"), "all", losers_only=True).filter("n_removed > 0")
    return out.select("doc_id", "n_units", "n_removed", "n_spans", "spans", "keep_doc_ids", F.sha2("kept_text", 256).alias("kept_sha256"))

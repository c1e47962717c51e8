"""Line dedup: sharded cuckoo filters in front of exact reference counts, so it can be undone.

State, three tables that driver and executors share:
  refs     one row for each line key and document that holds it: shard, hi, lo, doc_id
  counts   the exact reference counts: shard, hi, lo, n_docs, first_doc
  filters  one cuckoo filter for each shard, over the keys that at least two documents hold

insert() and delete() change refs and counts exactly and the filters of the touched shards only.
A filter only spares lookups: what it lets pass is settled by the exact counts. Filters are used at
every size: small ones where the texts are read, before anything is shuffled, large ones shard by shard.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, shipped, sliced, table
from .cuckoo import CuckooFilter

#: Shards are a power of two; a batch takes as many as keep SHARD_KEYS repeated keys or so in each.
MIN_CHARS, SHARDS, SHARD_KEYS = 10, 64, 1 << 20
#: Filters of at most this many bytes together are sent to the executors; larger ones meet the keys of
#: their shard in a shuffle, in SPREAD parts.
FILTER_BYTES, SPREAD = 32 << 20, 8
BLANK = b" \t\n\x0b\x0c\r"


class LineState(NamedTuple):
    refs: DataFrame | None
    counts: DataFrame
    filters: DataFrame
    shards: int | None = None  # of the filters, where it is not that of the refs


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 16-byte key for each line; None for lines with too short a key."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(BLANK).lower()  # on bytes, lower() changes A-Z only
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _refs_of(docs: DataFrame, min_chars: int, shards: int, wanted=None) -> DataFrame:
    """The distinct keys of each document; wanted: broadcast filters by shard that they have to pass."""

    def rows(batches):
        filters = None if wanted is None else {k: CuckooFilter.from_bytes(v) for k, v in wanted.value.items()}
        for batch in sliced(batches):
            keys, owner, names = [], [], batch.schema.names
            for doc, text in zip(batch.column(names.index("doc_id")).to_pylist(), batch.column(names.index("text")).to_pylist(), strict=True):
                own = {k for k in _keys(text, min_chars) if k}
                keys += own
                owner += [doc] * len(own)
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)  # hi is the second half
            shard = (pairs[:, 1] & (shards - 1)).astype(np.int32)
            docs_of = pa.array(owner, batch.column(names.index("doc_id")).type)
            if filters is not None:
                hit = np.zeros(len(pairs), bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    if s in filters:
                        hit[at] = filters[s].contains(pairs[at, 0])
                pairs, shard, docs_of = pairs[hit], shard[hit], docs_of.filter(pa.array(hit))
            yield pa.record_batch([pa.array(shard), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 0].copy()), docs_of], names=["shard", "hi", "lo", "doc_id"])

    if shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    kind = dict(docs.dtypes)["doc_id"]
    return shipped(docs).filter("doc_id is not null").select("doc_id", "text").mapInArrow(rows, f"shard int, hi long, lo long, doc_id {kind}")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "hi", "lo").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _filters(counts: DataFrame) -> DataFrame:
    """The filter of each shard over its repeated keys. A shard's keys come in batches of bounded size."""

    def build(batches):
        filters: dict[int, CuckooFilter] = {}
        for batch in batches:
            shard, lo = (batch.column(i).to_numpy() for i in range(2))
            for s in np.unique(shard):
                own = lo[shard == s]
                filters.setdefault(int(s), CuckooFilter(4 * len(own))).insert(own)
        yield pa.record_batch([pa.array(list(filters), pa.int32()), pa.array([f.to_bytes() for f in filters.values()], pa.binary())], names=["shard", "filter"])

    return counts.filter("n_docs >= 2").select("shard", "lo").repartition("shard").mapInArrow(build, "shard int, filter binary")


def _sent(spark, filters: DataFrame, limit: int):
    """The filters as a broadcast variable if they are small enough together, else None."""
    if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > limit:
        return None
    return spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})


def _sifted(refs: DataFrame, filters: DataFrame) -> DataFrame:
    """refs (hi, lo, doc_id) that the filter of their shard lets pass. Each shard's filter and refs meet
    in SPREAD parts, the filter first, and the refs stream past it."""
    shards = filters.agg(F.max("shards")).first()[0]
    if shards is None:
        return refs.limit(0)
    kind = dict(refs.dtypes)["doc_id"]
    own = refs.select((F.col("hi").bitwiseAND(F.lit(shards - 1))).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).alias("part"), F.lit(1).alias("side"), "hi", "lo", "doc_id")
    each = filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "filter")
    every = each.unionByName(own, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", "side")

    def rows(batches):
        held: tuple = (None, None, None)
        for batch in batches:
            shard, part, side = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("shard", "part", "side"))
            lo = batch.column(batch.schema.get_field_index("lo")).to_numpy()
            hit = np.zeros(len(batch), bool)
            edges = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(batch)], strict=True):
                if side[a] == 0:
                    held = shard[a], part[a], CuckooFilter.from_bytes(batch.column(batch.schema.get_field_index("filter"))[a].as_py())
                elif held[:2] == (shard[a], part[a]):  # a shard without a filter has no repeated keys
                    hit[a:b] = held[2].contains(lo[a:b])
            yield batch.filter(pa.array(hit)).select(["hi", "lo", "doc_id"])

    return every.mapInArrow(rows, f"hi long, lo long, doc_id {kind}")


def build(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineState:
    refs = materialise(_refs_of(docs, min_chars, shards).distinct())
    counts = materialise(_counted(refs))
    return LineState(refs, counts, materialise(_filters(counts)))


def _change(state: LineState, refs: DataFrame, touched: DataFrame) -> LineState:
    """The state over refs, where only touched keys may have changed."""
    keys = ["shard", "hi", "lo"]
    touched = materialise(touched.select(*keys).distinct())
    new = materialise(_counted(refs.join(touched, keys, "left_semi")))
    old = state.counts.join(touched, keys, "left_semi")
    before = old.select(*keys, F.col("n_docs").alias("before"))
    turned = before.join(new.select(*keys, F.col("n_docs").alias("after")), keys, "full").select("shard", "lo", (F.coalesce("before", F.lit(0)) >= 2).alias("was"), (F.coalesce("after", F.lit(0)) >= 2).alias("now")).filter("was <> now")

    def update(_, held, changes):
        lo, now = changes.column("lo").to_numpy(), changes.column("now").to_numpy(zero_copy_only=False)
        f = CuckooFilter.from_bytes(held.column("filter")[0].as_py()) if len(held) else CuckooFilter(len(lo))
        f.delete(lo[~now])
        f.insert(lo[now])
        shard = (held if len(held) else changes).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})

    changed = state.filters.groupBy("shard").cogroup(turned.select("shard", "lo", "now").groupBy("shard")).applyInArrow(update, "shard int, filter binary")
    counts = state.counts.join(touched, keys, "left_anti").unionByName(new)
    return LineState(materialise(refs), materialise(counts), materialise(changed))


def insert(state: LineState, docs: DataFrame, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineState:
    """The state with more documents. Inserting a document twice changes nothing."""
    new = materialise(_refs_of(docs, min_chars, shards).distinct().join(state.refs, ["shard", "hi", "lo", "doc_id"], "left_anti"))
    return _change(state, state.refs.unionByName(new), new)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents in doc_ids (column doc_id): as if they had never come."""
    gone = doc_ids.select("doc_id").distinct()
    removed = materialise(state.refs.join(gone, "doc_id", "left_semi"))
    return _change(state, state.refs.join(gone, "doc_id", "left_anti").select("shard", "hi", "lo", "doc_id"), removed)


def _drops(refs: DataFrame, counts: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """key_, drop_: a doc_id and the keys whose lines that document loses. Refs pass the filters, if
    any are given, before they are looked up; those of hot keys need not."""
    sift = None if filters is None else (lambda cold: _sifted(cold, filters))
    lost = lookup(refs.select("hi", "lo", "doc_id"), counts.select("hi", "lo", "n_docs", "first_doc"), ["hi", "lo"], "n_docs", sift=sift).filter("doc_id <> first_doc")
    return lost.groupBy(F.col("doc_id").alias("key_")).agg(F.collect_set(F.struct("hi", "lo")).alias("drop_"))


def apply(docs: DataFrame, state: LineState, min_chars: int = MIN_CHARS, shards: int = SHARDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for each row of docs, by the state's counts.

    Every document loses its lines with a key that a document with a smaller doc_id holds as well.
    A null or empty text is one empty line. Keys under min_chars code points never go. Rows that
    share a doc_id count as one document that holds the lines of all of them. A row with a null
    doc_id neither counts nor loses lines. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    marked = _marked(docs.select("doc_id", "text"), state, min_chars, shards, filter_bytes)

    def rows(batches):
        for batch in sliced(batches):
            done = _without(batch, min_chars)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), *(pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64())))], names=["doc_id", "kept_text", "n_lines", "n_dropped"])

    return marked.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, kept_text string, n_lines long, n_dropped long")


def _marked(docs: DataFrame, state: LineState, min_chars: int, shards: int, filter_bytes: int) -> DataFrame:
    """docs with drop_, the keys whose lines each row loses."""
    shards = state.shards or shards
    sent = _sent(docs.sparkSession, state.filters, filter_bytes)
    filters = None if sent is not None else state.filters.withColumn("shards", F.lit(shards))
    drops = _drops(_refs_of(docs, min_chars, shards, sent), state.counts.filter("n_docs >= 2"), filters)
    return docs.join(drops, docs["doc_id"] == drops["key_"], "left").drop("key_")


def _without(batch: pa.RecordBatch, min_chars: int) -> list[tuple[str, int, int]]:
    """For each row of marked documents: the text that stays, its lines before and those dropped."""
    text, drop = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "drop_"))
    out = []
    for t, d in zip(text, drop, strict=True):
        lines = (t or "").split("\n")
        n = len(lines)
        if d:
            lost = {x["lo"].to_bytes(8, "little", signed=True) + x["hi"].to_bytes(8, "little", signed=True) for x in d}
            lines = [x for x, k in zip(lines, _keys(t, min_chars), strict=True) if k not in lost]
        out.append(("\n".join(lines), n, n - len(lines)))
    return out


def _state_of(docs: DataFrame, min_chars: int, shards: int) -> LineState:
    """Counts and filters of the repeated keys of docs alone, which is all that one pass needs."""
    refs = _refs_of(docs, min_chars, shards)
    ends = refs.groupBy("shard", "hi", "lo").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    counts = materialise(ends.filter("first_doc < last_doc").drop("last_doc"))
    while shards * SHARD_KEYS < counts.count():
        shards *= 2
    counts = counts.withColumn("shard", F.col("hi").bitwiseAND(F.lit(shards - 1)).cast("int"))
    return LineState(None, counts, materialise(_filters(counts)), shards)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int = SHARDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """apply() to docs with the counts over docs themselves."""
    return apply(docs, _state_of(docs, min_chars, shards), min_chars, shards, filter_bytes)


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int = SHARDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs with all their columns and rows, the text without its repeated lines; n_chars, if there
    is such a column, counts what stays."""
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row_"))
    marked = _marked(whole, _state_of(docs, min_chars, shards), min_chars, shards, filter_bytes)
    columns, schema = docs.columns, docs.schema

    def rows(batches):
        for batch in sliced(batches):
            done = [x[0] for x in _without(batch, min_chars)]
            own = dict(zip(columns, batch.column(batch.schema.get_field_index("row_")).flatten(), strict=True))
            own["text"] = pa.array(done, pa.string())
            if "n_chars" in own:
                own["n_chars"] = pa.array([len(t) for t in done], pa.int64()).cast(own["n_chars"].type)
            yield pa.record_batch(list(own.values()), names=columns)

    return marked.mapInArrow(rows, schema)


def op10_line_dedup(spark, sf_dir):
    """Every document: its lines, how many of them go, and what stays."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
dup AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, line, i, coalesce(doc_id <> first_doc, false) AS gone FROM keyed LEFT JOIN dup USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

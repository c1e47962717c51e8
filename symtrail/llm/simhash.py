"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints that differ in at most r bits are found without missing any: every bit position gets a
vector of r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors v makes a mask of the positions
whose vector has an odd product with v. The vectors of r differing positions leave some v orthogonal
to all of them, so under that mask, which skips all of these positions, the two agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import lookup, materialise, shipped, sliced, table

SHINGLE, RADIUS, SEED = 4, 4, 42
#: A bucket of more distinct fingerprints is split by a second set of masks.
BUCKET = 4096


def covering_masks(positions: list[int], radius: int) -> np.ndarray:
    """The masks over the given bit positions: any `radius` of them are all left out by some mask.

    Positions get the nonzero vectors in turn, so each mask keeps at least half of them.
    """
    vectors = (1 << (radius + 1)) - 1
    own = [1 + i % vectors for i in range(len(positions))]
    return np.array([sum(1 << p for p, w in zip(positions, own, strict=True) if (v & w).bit_count() % 2) for v in range(1, vectors + 1)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # on bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text needs no more memory
        part = np.array([digest(data[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long: the 64 bits) for each row; null and wordless texts have fingerprint zero."""

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(names.index("text")).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(names.index("doc_id")), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return shipped(docs).select("doc_id", "text").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _tables(fps: DataFrame, radius: int, mask_sets: dict | None = None) -> DataFrame:
    masks = covering_masks(list(range(64)), radius).view(np.int64).tolist()
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("t")
    return fps.select("fp", rows).select("fp", "t.mask", "t.key")


def _linked(order: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius of each other among distinct fingerprints.

    A search that takes each one out of the rest when it is first reached: the links are a forest,
    and a group in which all are close costs one pass, not all its pairs.
    """
    rest, left, right = order, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got = rest[near]
                left.append(np.full(len(got), x, np.uint64))
                right.append(got)
                front += got.tolist()
                front = [np.uint64(f) for f in front]
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _within(radius: int):
    def rows(batches):
        """Batches sorted by mask and key: each run of equal ones is a bucket."""
        held = np.zeros((0, 3), np.int64)

        def links(data: np.ndarray):
            if not len(data):
                return
            edge = np.flatnonzero(np.append(True, (data[1:, :2] != data[:-1, :2]).any(1)))
            size = np.diff(np.append(edge, len(data)))
            left, right = [], []
            at = edge[size == 2]
            a, b = data[at, 2].view(np.uint64), data[at + 1, 2].view(np.uint64) if len(at) else data[at, 2].view(np.uint64)
            near = np.bitwise_count(a ^ b) <= radius
            left.append(a[near])
            right.append(b[near])
            for s, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found = _linked(np.ascontiguousarray(data[s : s + n, 2]).view(np.uint64), radius)
                left.append(found[0])
                right.append(found[1])
            out = np.concatenate(left), np.concatenate(right)
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in out], names=["a", "b"])

        for batch in batches:
            data = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)])
            last = np.flatnonzero((data[:, :2] != data[-1, :2]).any(1)) if len(data) else []
            stop = int(last[-1]) + 1 if len(last) else 0
            yield from links(np.ascontiguousarray(data[:stop]))
            held = data[stop:]
        yield from links(np.ascontiguousarray(held))

    return rows


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that join exactly the distinct fingerprints (column fp) that chains of
    differences of at most `radius` bits join.

    Buckets of one are dropped by a count. A bucket of more than `bucket` is dealt anew by masks over
    the bits that its own mask skips; after that at most 2^16 different values can share one, at any
    size of the corpus. Within a bucket a forest of links is made, never all pairs.
    """
    dealt = _tables(fps, radius)
    sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialise(sizes)
    rows = lookup(dealt, sizes, ["mask", "key"], "n")
    small = rows.filter(F.col("n") <= bucket).select("mask", "key", "fp")
    masks = covering_masks(list(range(64)), radius)
    second = [covering_masks([p for p in range(64) if not int(m) >> p & 1], radius) | m for m in masks]
    finer = F.array(*[F.array(*[F.lit(int(x)) for x in s.view(np.int64)]) for s in second])
    large = (
        rows.filter(F.col("n") > bucket)
        .select("mask", "fp", F.posexplode(F.element_at(finer, F.col("mask") + 1)).alias("pos", "m"))
        .select((F.lit(100) + F.col("mask") * 100 + F.col("pos")).alias("mask"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    )
    every = small.unionByName(large).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return every.mapInArrow(_within(radius), "a long, b long").distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach; null
    only where no doc_id of the component is known. Null, empty and wordless texts have fingerprint
    zero and are linked like any other; repeated rows share a fingerprint. Documents with equal
    fingerprints are one class, and only classes are linked. Other columns are ignored.
    """
    rows = materialise(fingerprints(docs, shingle, seed))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    member = components(fingerprint_links(classes.select("fp"), radius))
    named = classes.join(member.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialise(named.join(best, "root").select("fp", "n", "component_id"))
    out = lookup(rows, labels, ["fp"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs, with all their columns, of which the document with the least doc_id of each group stays.

    Rows that repeat its doc_id stay with it. Rows with a null doc_id stay only in a group where no
    doc_id is known.
    """
    kept = near_groups(docs, **parameters).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id_"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id_"]), "left_semi")


def op7_simhash_near_dedup(spark, sf_dir):
    """Every document with its fingerprint and its group."""
    return near_groups(table(spark, sf_dir, "documents"))

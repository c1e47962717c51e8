"""Suffix-array dedup by a depth-limited radix sort: equal groups are the repeated windows.

Two places of the corpus matter to each other only if the L bytes from there agree, so suffixes are
ordered through L bytes and no further, most significant digit first, and a suffix that is alone in
its group leaves the sort. The digits are chosen so that a pass takes many suffixes at once:

  pass 1  The digit is the K-byte string in the window whose hash is least (the leftmost of equal
          ones). Equal windows have the same one, at the same offset p from their start. Neighbouring
          suffixes share it: they form a run, a stretch of at most 2 L - K bytes.
  then    Every further pass cuts what is left of a run into pieces by p, on a grid that gets finer
          from pass to pass. The digit of a piece is its core, the bytes that all windows of its cell
          of the grid share; as cells narrow to one window, cores grow to L bytes.

In each pass (pass 1 too) pieces that are equal as a whole are settled: all their windows repeat. A
group goes on with one piece of each different kind, if there are several and one is not settled.
So a run makes a few rows a pass at each end of what it shares, however large its group; groups are
aggregates with map-side partials, never rows of one task.

Pieces are equal by 128-bit BLAKE2b digests of their bytes. The rolling hashes of pass 1 only choose
and group: strings that collide there share a group, and no more.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, materialise, shipped, sliced, table

LENGTH, ANCHOR = 400, 128
#: How many times finer the grid of offsets gets from pass to pass.
FAN = 4
_PLACE = 18
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: two running minima over blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _runs(pieces: list[bytes], length: int, anchor: int):
    """Runs of byte strings: piece, first and last window, anchor place, its hash, the run's digest."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    joined = b"".join(pieces)
    flat = np.frombuffer(joined, np.uint8)
    n = len(flat)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
    if n < length:
        return none
    up, down = _powers((1 << _PLACE) + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[flat] * up[:n], out=total[1:])
    grams = _mixed((total[anchor:] - total[: n - anchor + 1]) * down[: n - anchor + 1])
    place = np.uint64((1 << _PLACE) - 1)
    least = _sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1) & place
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: n - length + 1]
    at = np.flatnonzero(np.arange(n - length + 1) + length <= ends[piece])
    if not len(at):
        return none
    where = least[at].astype(np.int64)
    new = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    anchors, owner = where[new], piece[at[new]]
    view = memoryview(joined)
    digest = _digests(view[x:y] for x, y in zip(first.tolist(), (last + length).tolist(), strict=True))
    base = (ends - sizes)[owner]
    return owner, first - base, last - base, anchors - base, grams[anchors], digest


def _digests(strings) -> np.ndarray:
    """Two longs for each byte string, its 128-bit digest."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in strings), "<i8").reshape(-1, 2)


def _pieces(text: bytes, length: int):
    """Stretches of a long text that hold each of its windows once, with their offsets."""
    limit = 1 << (_PLACE - 1)
    for at in range(0, max(1, len(text) - length + 1), limit):
        yield at, text[at : at + limit + length - 1]


def _anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def rows(batches):
        def done(pieces, ids):
            owner, first, last, where, gram, run = _runs(pieces, length, anchor)
            doc, tag, base = (np.array(x, np.int64)[owner] for x in zip(*ids, strict=True))
            cols = [gram.view(np.int64), run[:, 0].copy(), run[:, 1].copy(), doc, tag, first + base, last + base, where + base]
            return pa.record_batch([pa.array(c) for c in cols], names=["gram", "hi", "lo", "id_", "tag_", "first", "last", "at"])

        pieces, ids, size = [], [], 0
        for batch in sliced(batches):
            names = batch.schema.names
            for doc, tag, text in zip(*(batch.column(names.index(x)).to_pylist() for x in ("id_", "tag_", "text")), strict=True):
                data = (text or "").encode()
                if len(data) < length:
                    continue
                for base, piece in _pieces(data, length):
                    if pieces and size + len(piece) > 1 << _PLACE:
                        yield done(pieces, ids)
                        pieces, ids, size = [], [], 0
                    pieces.append(piece)
                    ids.append((doc, tag, base))
                    size += len(piece)
        if pieces:
            yield done(pieces, ids)

    return docs.mapInArrow(rows, "gram long, hi long, lo long, id_ long, tag_ long, first long, last long, at long")


def _widths(length: int, anchor: int, fan: int) -> list[int]:
    """Cell widths of the grid of offsets 0 to length - anchor in each pass after the first."""
    widths = [1]
    while widths[0] * fan * 2 < length - anchor + 1:
        widths.insert(0, widths[0] * fan)
    return widths


def _cells(length: int, anchor: int, width: int):
    """Cut each run's pieces (offsets from low to high) by the grid; digests of cores and of pieces."""

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            own = {n: batch.column(names.index(n)).to_pylist() for n in ("at", "first", "bytes", "pieces")}
            row, low, high, n, cores, wholes = [], [], [], [], [], []
            for i, (at, first, data, pieces) in enumerate(zip(*own.values(), strict=True)):
                anchored, view = at - first, memoryview(data)
                for piece in pieces:
                    for cell in range(piece["low"] // width, piece["high"] // width + 1):
                        begin, stop = cell * width, min((cell + 1) * width - 1, length - anchor)
                        a, b = max(piece["low"], begin), min(piece["high"], stop)
                        row.append(i)
                        low.append(a)
                        high.append(b)
                        n.append(piece["n"])
                        wholes.append(view[anchored - b : anchored - a + length])
                        cores.append(blake2b(view[anchored - begin : anchored - stop + length], digest_size=8, salt=cell.to_bytes(16, "little")).digest())
            whole = _digests(wholes)
            key = [batch.column(names.index(x)).take(pa.array(row, pa.int64())) for x in ("id_", "tag_", "first", "at")]
            cols = [np.frombuffer(b"".join(cores), "<i8"), whole[:, 0].copy(), whole[:, 1].copy()]
            yield pa.record_batch([*map(pa.array, cols), *key, *(pa.array(x, pa.int64()) for x in (low, high, n))], names=["gram", "hi", "lo", "id_", "tag_", "first", "at", "low", "high", "n"])

    return rows


_CELL = "gram long, hi long, lo long, id_ long, tag_ long, first long, at long, low long, high long, n long"
_WHOLE = ["gram", "hi", "lo"]


def _pass(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """One pass over pieces (_CELL; gram is the digit, hi and lo the piece as a whole, n the number
    of equal pieces that a row stands for, of which more than one are settled already).

    The spans of pieces settled now, and the pieces that go on by the run that they are of. Pieces
    alone in their group, which most are, leave before anything else is done."""
    shared = materialise(pieces.groupBy("gram").agg(F.count("*").alias("many")).filter("many > 1"))
    pieces = materialise(lookup(pieces, shared, ["gram"], "many").drop("many"))
    one = F.min(F.struct("id_", "tag_", "first", "at", "low", "high")).alias("one")
    kinds = materialise(pieces.groupBy(*_WHOLE).agg(F.sum("n").alias("n"), one))
    same = kinds.filter("n > 1").select(*_WHOLE, F.col("n").alias("same"))
    settled = lookup(pieces.filter("n = 1"), same, _WHOLE, "same")
    spans = settled.select("id_", "tag_", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    groups = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    left = lookup(kinds, materialise(groups.select("gram", "kinds")), ["gram"], "kinds")
    by_run = left.groupBy("one.id_", "one.tag_", "one.first", "one.at").agg(F.collect_list(F.struct("one.low", "one.high", "n")).alias("pieces"))
    return spans, by_run


def _with_bytes(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """runs (id_, tag_, first, at, pieces) with the bytes of their pieces, cut from the texts."""
    wanted = runs.groupBy("id_", "tag_").agg(F.collect_list(F.struct("first", "at", "pieces")).alias("runs_"))

    def rows(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            of, data = [], []
            held = batch.column(names.index("runs_"))
            for i, (text, runs) in enumerate(zip(batch.column(names.index("text")).to_pylist(), held.to_pylist(), strict=True)):
                text = (text or "").encode()
                of += [i] * len(runs)
                data += [text[x["first"] : x["at"] - min(p["low"] for p in x["pieces"]) + length] for x in runs]
            key = [batch.column(names.index(x)).take(pa.array(of, pa.int64())) for x in ("id_", "tag_")]
            yield pa.record_batch([*key, *held.flatten().flatten(), pa.array(data, pa.binary())], names=["id_", "tag_", "first", "at", "pieces", "bytes"])

    # rows that repeat (id_, tag_) are one text
    texts = docs.join(wanted, ["id_", "tag_"]).dropDuplicates(["id_", "tag_"])
    return texts.mapInArrow(rows, "id_ long, tag_ long, first long, at long, pieces array<struct<low:bigint,high:bigint,n:bigint>>, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, fan: int = FAN) -> DataFrame:
    """id_, tag_, start, end in bytes: stretches whose windows of `length` bytes start elsewhere too.

    docs has id_, tag_ (which name a row) and text. The stretches of a row may overlap.
    """
    found = materialise(_anchored(docs, length, anchor))
    offsets = [(F.col("at") - F.col("last")).alias("low"), (F.col("at") - F.col("first")).alias("high"), F.lit(1).cast("long").alias("n")]
    spans, runs = _pass(found.select(*_WHOLE, "id_", "tag_", "first", "at", *offsets), length)
    runs = materialise(_with_bytes(docs, runs, length))
    widths = _widths(length, anchor, fan)
    for width in widths:
        pieces = materialise(runs.mapInArrow(_cells(length, anchor, width), _CELL))
        more, left = _pass(pieces, length)
        spans = spans.unionByName(more)
        if width > 1:  # a piece of one window is its core
            runs = materialise(runs.drop("pieces").join(left, ["id_", "tag_", "first", "at"]))
            if runs.isEmpty():
                break
    return spans


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    text or in another row's; strings are judged on the input and never cross rows. Null texts count
    as empty; texts shorter than `length` stay whole. Repeated rows repeat each other, so they go.
    doc_ids may be null or of any type; other columns are ignored. kept may end within a character.
    """
    rows = shipped(docs).select("doc_id", F.xxhash64("doc_id").alias("id_"), F.xxhash64("doc_id", "text").alias("tag_"), "text")
    spans = repeated_spans(rows.drop("doc_id"), length, anchor, fan)
    by_row = spans.groupBy("id_", "tag_").agg(F.collect_set(F.struct("start", "end")).alias("spans_"))

    def cleaned(batches):
        for batch in sliced(batches):
            names = batch.schema.names
            out = []
            for text, spans in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("spans_")).to_pylist(), strict=True):
                data = (text or "").encode()
                out.append((len(data), *cut(data, [(x["start"], x["end"]) for x in spans or ()])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            order = (0, 2, 3, 1)
            yield pa.record_batch([batch.column(names.index("doc_id")), *(pa.array([x[o] for x in out], k) for o, k in zip(order, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(by_row, ["id_", "tag_"], "left").mapInArrow(cleaned, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark, sf_dir):
    """Every document: its bytes, how many of them go in how many runs, and what stays."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

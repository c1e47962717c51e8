"""Watching a source tree: file events as a stream, coalesced by path and applied to the facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rank import LANGUAGE_OF

EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("path", T.StringType()), T.StructField("new_path", T.StringType())])
#: Extensions that are watched and scanned, in lower case only. (Haxe can be parsed but is not found.)
SUPPORTED = tuple(sorted(e for e in LANGUAGE_OF if e != "hx"))
DEBOUNCE, BATCH = "200 milliseconds", "100 milliseconds"


def meaningful(raw: DataFrame) -> DataFrame:
    """Raw notices (kind, paths) as events: changes of metadata or access and unknown kinds go, the
    first path with a supported extension counts, and what kind of change is left open is Modified."""
    kind = F.col("kind")
    op = F.when(kind.startswith("create"), "Created").when(kind.startswith("remove"), "Deleted").when(kind.isin("modify", "modify/any", "any") | kind.startswith("modify/data/content") | kind.startswith("modify/name"), "Modified")
    supported = F.filter("paths", lambda p: F.regexp_extract(p, r"\.([^./]+)$", 1).isin(*SUPPORTED))
    return raw.withColumns({"op": op, "path": F.get(supported, F.lit(0))}).filter("op is not null and path is not null").drop("kind", "paths")


def moves(events: DataFrame) -> DataFrame:
    """Each event as update or delete of one path; a rename deletes the old path and updates the new."""
    old = F.struct(F.when(F.col("op").isin("Deleted", "Renamed"), "delete").otherwise("update").alias("action"), F.col("path").alias("path"))
    new = F.struct(F.lit("update").alias("action"), F.col("new_path").alias("path"))
    both = F.when(F.col("op") == "Renamed", F.array(old, new)).otherwise(F.array(old))
    return events.select("ts", "seq", F.posexplode(both).alias("part", "m")).select("ts", "seq", "part", "m.*")


def coalesced(events: DataFrame, *keys: str) -> DataFrame:
    """path, action: what the last event of each path leaves to do."""
    return moves(events).groupBy(*keys, "path").agg(F.max_by("action", F.struct("seq", "part")).alias("action"))


def windowed(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """coalesced() in event-time windows; with `late`, a watermark lets a stream forget old windows."""
    rows = moves(events)
    rows = rows if late is None else rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length).alias("w"), "path").agg(F.max_by("action", F.struct("seq", "part")).alias("action"), F.count("*").alias("events"))


def apply_batch(events: DataFrame, store, extract: Callable[[DataFrame], dict[str, DataFrame]], batch_id: int | None = None) -> dict[str, int]:
    """One micro-batch: facts of deleted paths go, those of updated paths are extracted anew.

    Extraction comes first and the store changes in one step, so a failure leaves the old facts. A
    batch that was applied before, by its number, is skipped: replays change nothing.
    """
    if batch_id is not None and batch_id <= int(store.metadata("last_batch") or -1):
        return {"updated": 0, "deleted": 0, "skipped": 1}
    todo = coalesced(events).persist()
    try:
        updates, deletes = todo.filter("action = 'update'").select("path"), todo.filter("action = 'delete'").select("path")
        store.replace_files(todo.select("path"), extract(updates), {} if batch_id is None else {"last_batch": str(batch_id)})
        return {"updated": updates.count(), "deleted": deletes.count(), "skipped": 0}
    finally:
        todo.unpersist()


def watch(stream: DataFrame, store, extract: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply a stream of events to the store batch by batch; once: what is there now, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(df, store, extract, i) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=BATCH)).start()


def rate_limited(requests: DataFrame, limit: int = 30, seconds: float = 1.0, key: str = "client") -> DataFrame:
    """requests (key, ts, seq) with allowed: at most `limit` allowed ones in the trailing time.

    Denied requests don't count, so each answer hangs on the ones before it: one key's requests are
    read in order, batch by batch, and only the last `limit` allowed times are remembered.
    """
    kind = dict(requests.dtypes)[key]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict = {}
        last = None
        for batch in batches:
            allowed = []
            for who, at in zip(batch[key], batch["micros_"], strict=True):
                if who != last:
                    recent, last = {who: []}, who
                held = [t for t in recent[who] if t > at - seconds * 1e6]
                ok = len(held) < limit
                recent[who] = [*held, at] if ok else held
                allowed.append(ok)
            yield batch[[key, "seq"]].assign(allowed=allowed)

    ordered = requests.select(key, "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros_")).repartition(key).sortWithinPartitions(key, "micros_", "seq")
    return ordered.mapInPandas(rows, f"{key} {kind}, seq long, allowed boolean")


def rate_limited_stream(requests: DataFrame, limit: int = 30, seconds: float = 1.0) -> DataFrame:
    """rate_limited() over a stream with columns client (string), ts, seq; state is a list of times."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(who, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        allowed = []
        for at in rows["ts"].astype("datetime64[us]").astype("int64"):
            held = [t for t in held if t > at - seconds * 1e6]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(at)
        state.update((held,))
        yield pd.DataFrame({"client": who[0], "seq": rows["seq"], "allowed": allowed})

    return requests.groupBy("client").applyInPandasWithState(step, "client string, seq long, allowed boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


"""A source tree and its fact store in one call: build, refresh on read, watch by polling."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract
from .operators.incremental import stale_files
from .scratch import materialise
from .shipping import ship
from .sources import scan
from .store import FactStore

RELATIONS = ("symbols", "refs", "opens", "file_mtimes")


def facts_of(files: DataFrame, config: scan.Config, first_id: int = 1) -> dict[str, DataFrame]:
    """The facts of files (path, mtime), read and extracted on the executors."""
    ship(files.sparkSession)
    found = extract.facts(extract.extract(scan.read_sources(files), config.max_recursion_depth), first_id)
    return {name: found[name] for name in RELATIONS}


def build(spark: SparkSession, root: str, store_path: str) -> FactStore:
    """A store of a whole tree; one that exists is filled anew, in one step."""
    config = scan.Config.load(root)
    store = FactStore(spark, store_path).open_or_create()
    with store.writer():
        store.overwrite(**facts_of(scan.list_files(spark, root, config), config))
        store.set_metadata("root", root)
    return store


def changes(store: FactStore, root: str) -> DataFrame:
    """path, reason, mtime: how the tree differs from what the store has of it."""
    disk = scan.list_files(store.spark, root)
    return stale_files(store.read("file_mtimes"), disk).join(disk.select("path", "mtime"), "path", "left")


def refresh(store: FactStore, root: str) -> int:
    """Bring a store up to date with its tree, all changed files in one step; how many there were."""
    config, stale = scan.Config.load(root), materialise(changes(store, root))
    n = stale.count()
    if n:
        first = max(store.next_id(name) for name in ("symbols", "refs", "opens"))
        there = stale.filter("reason <> 'deleted'").select("path", "mtime")
        with store.writer():
            store.replace_files(stale.select("path"), facts_of(there, config, first))
    return n


def fresh(store: FactStore, root: str, relation: str) -> DataFrame:
    """A relation as the tree is now: reading refreshes first."""
    refresh(store, root)
    return store.read(relation)


def watch(store: FactStore, root: str, every: float = 1.0, stop: Callable[[int], bool] = lambda n: False) -> int:
    """Refresh again and again until stop(rounds so far) says so; how many files changed in all."""
    rounds = changed = 0
    while not stop(rounds):
        changed += refresh(store, root)
        rounds += 1
        if not stop(rounds):
            time.sleep(every)
    return changed


def edited(text: str, edits: list[tuple[tuple[int, int] | None, tuple[int, int] | None, str]]) -> str:
    """An open document after an editor's edits, one after the other: each replaces what is between
    two places (line, character, both from 0), or the whole text if it has none. Characters count in
    UTF-16 units, as editors count them; places beyond a line or the text mean its end."""

    def offset(place: tuple[int, int]) -> int:
        line, character = place
        lines = text.split("\n")
        if line >= len(lines):
            return len(text)
        units = at = 0
        for c in lines[line]:
            if units >= character:
                break
            units += 1 + (ord(c) > 0xFFFF)
            at += 1
        return sum(len(x) + 1 for x in lines[:line]) + at

    for start, end, new in edits:
        text = new if start is None or end is None else text[: offset(start)] + new + text[offset(end) :]
    return text


def counts(store: FactStore) -> DataFrame:
    """relation, n: the size of each relation."""
    every = None
    for name in RELATIONS:
        own = store.read(name).agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        every = own if every is None else every.unionByName(own)
    return every

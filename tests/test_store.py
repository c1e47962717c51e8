"""The fact store when writers meet, stop half-way, or add bit by bit; and the project registry."""

import json
import os

import pytest

from symtrail.operators.projects import ProjectRegistry, definitions
from symtrail.store import FOLDERS, FactStore, StoreError

SYMBOL = "id long, name string, qualified string, kind string, file string, line int, column int"


def rows(spark, *names, first=1):
    return spark.createDataFrame([(first + i, n, f"m.{n}", "function", f"{n}.py", 1, 1) for i, n in enumerate(names)], SYMBOL)


def names(store):
    return sorted(r["name"] for r in store.read("symbols").collect())


def test_a_writer_that_stops_leaves_the_last_version(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2).create()
    store.overwrite(symbols=rows(spark, "a", "b"))
    store._write("symbols", rows(spark, "lost"))  # folders without a pointer
    open(tmp_path / "s" / "pointers" / ".half", "w").close()  # a pointer that was never renamed
    assert names(FactStore(spark, store.path, buckets=2).open()) == ["a", "b"]


def test_two_writers_do_not_lose_a_change(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=2).create()
    mine, theirs = store._pointer(), store._pointer()
    mine["metadata"]["who"] = "me"
    theirs["metadata"]["who"] = "they"
    store._point(mine)
    with pytest.raises(StoreError):
        store._point(theirs)
    assert store.metadata("who") == "me"


def test_one_writer_holds_the_lock(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s")).create()
    with store.writer():
        with pytest.raises(StoreError):
            with FactStore(spark, store.path).writer():
                pass
    lock = tmp_path / "s" / "LOCK"
    assert not lock.exists()
    import socket

    lock.write_text(json.dumps({"host": socket.gethostname(), "pid": 2**22 + 1}))  # a process that is no more
    with store.writer():
        store.set_metadata("k", "v")
    assert store.metadata("k") == "v"


def test_appends_add_folders_and_are_joined_in_time(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), buckets=1).create()
    for i in range(FOLDERS + 2):
        store.append("symbols", rows(spark, f"n{i:02d}", first=i))
    assert names(store) == [f"n{i:02d}" for i in range(FOLDERS + 2)]
    assert len(store._pointer()["relations"]["symbols"]["0"]) <= FOLDERS
    store.delete_where("symbols", "id < 3")
    assert len(names(store)) == FOLDERS - 1


def test_projects_are_registered_and_asked(spark, tmp_path):
    registry = ProjectRegistry(spark, str(tmp_path / "projects.json"))
    roots = []
    for name in ("one", "two"):
        root = tmp_path / name
        root.mkdir()
        FactStore(spark, str(root / ".symtrail"), buckets=1).create().overwrite(symbols=rows(spark, "shared", name))
        roots.append(registry.register(str(root)))
    with pytest.raises(StoreError):
        registry.register(str(tmp_path))
    assert registry.list() == sorted(roots) and registry.register(roots[0]) == roots[0]
    assert registry.resolve(root=os.path.join(roots[0], "src")) == [roots[0]]
    assert registry.resolve(root="/etc") == []
    assert registry.resolve(file=os.path.join(roots[1], "a.py")) == [roots[1]]
    assert registry.resolve(cwd=roots[0]) == [roots[0]] and registry.resolve(cwd="/") == sorted(roots)
    every = registry.symbols()
    assert {r["project"] for r in definitions(every, "m.shared").collect()} == set(roots)
    assert [r["project"] for r in definitions(every, "two").collect()] == [roots[1]]
    assert names(registry.reload(roots[0])) == ["one", "shared"]
    assert registry.unregister(roots[0]) and not registry.unregister(roots[0]) and registry.list() == [roots[1]]


def test_a_large_bucket_is_written_in_pieces(spark, tmp_path):
    n = 60_000
    refs = spark.range(0, n, 1, 4).selectExpr("id", "concat('n', sha2(cast(id as string), 256)) as name", "'a.py' as file", "cast(id as int) as line", "1 as column")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store = FactStore(spark, str(tmp_path / "s"), buckets=8).create()
        store.overwrite(refs=refs)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    (folders,) = store._pointer()["relations"]["refs"].values()
    pieces = [f for folder in folders for f in os.listdir(os.path.join(store.path, folder)) if f.endswith(".parquet")]
    assert len(folders) == 1 and len(pieces) > 3
    assert store.read("refs").exceptAll(refs.select(store.read("refs").columns)).count() == 0 and store.read("refs").count() == n


def test_a_large_append_is_written_in_pieces(spark, tmp_path):
    n = 60_000
    store = FactStore(spark, str(tmp_path / "s"), buckets=8).create()
    store.overwrite(refs=spark.createDataFrame([(-1, "x", "a.py", 1, 1)], "id long, name string, file string, line int, column int"))
    more = spark.range(0, n, 1, 4).selectExpr("id", "concat('n', sha2(cast(id as string), 256)) as name", "'a.py' as file", "cast(id as int) as line", "1 as column")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store.append("refs", more)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    (folders,) = store._pointer()["relations"]["refs"].values()
    pieces = [f for f in os.listdir(os.path.join(store.path, folders[-1])) if f.endswith(".parquet")]
    assert len(folders) == 2 and len(pieces) > 3 and store.read("refs").count() == n + 1

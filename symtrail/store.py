"""A versioned store of the fact relations in Parquet, changed in one step.

A pointer file names the folders of each relation. Every change writes its new folders in full and
then the next pointer, which no later step alters: a reader takes the pointer with the highest number
and sees all of a change or nothing, whatever happens to the writer in between. A writer that finds
its number taken has lost a race and fails; nothing is overwritten. Large relations are laid out by
hash of the file in BUCKETS; a change rewrites only the buckets that hold a changed file, and an
append adds folders to buckets.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.incremental import upsert
from .schema import RELATIONS, SCHEMA_VERSION

BUCKETS = 64
#: Pointers kept for readers that are still at an older version, and folders of a bucket beyond which
#: an append rewrites it as one.
POINTERS, FOLDERS = 8, 16
_BY_FILE = {"symbols": "file", "refs": "file", "opens": "file", "file_mtimes": "path"}


class StoreError(Exception):
    pass


class FactStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # the pointer: relation -> {bucket or "all": [folder]}

    def _fs(self, name: str = "pointers"):
        """The JVM, a path of the store and its file system."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        _, where, fs = self._fs()
        if not fs.exists(where):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def exists(self) -> bool:
        return bool(self._numbers())

    def _read(self, name: str) -> str:
        jvm, where, fs = self._fs(name)
        stream = fs.open(where)
        try:
            return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _pointer(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            raise StoreError(f"no store at {self.path}")
        return json.loads(self._read(f"pointers/{numbers[-1]:012d}.json")) | {"number": numbers[-1]}

    def _point(self, pointer: dict) -> None:
        """The next pointer, by a rename that fails if its number is taken."""
        jvm, where, fs = self._fs()
        number = pointer.pop("number", 0) + 1
        path = jvm.org.apache.hadoop.fs.Path
        new, final = path(f"{self.path}/pointers/.{uuid.uuid4().hex}"), path(f"{self.path}/pointers/{number:012d}.json")
        fs.mkdirs(where)
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(new, False)
            raise StoreError(f"version {number} was written by someone else") from e
        for old in self._numbers()[:-POINTERS]:
            fs.delete(path(f"{self.path}/pointers/{old:012d}.json"), False)

    # one writer at a time

    @contextlib.contextmanager
    def writer(self):
        """Hold the store's lock; an error if a living process holds it. The lock of a process of this
        host that is no more is taken over."""
        jvm, where, fs = self._fs("LOCK")
        me = {"host": socket.gethostname(), "pid": os.getpid(), "token": uuid.uuid4().hex}
        if fs.exists(where):
            holder = json.loads(self._read("LOCK") or "{}")
            if holder.get("host") != me["host"] or _alive(holder.get("pid", 0)):
                raise StoreError(f"process {holder.get('pid')} on {holder.get('host')} is writing")
            fs.delete(where, False)
        try:
            out = fs.create(where, False)
        except Exception as e:
            raise StoreError("another process is writing") from e
        out.write(bytearray(json.dumps(me).encode()))
        out.close()
        try:
            yield self
        finally:
            fs.delete(where, False)

    # opening

    def create(self) -> FactStore:
        """An empty store; an error if there is one."""
        if self.exists():
            raise StoreError(f"a store exists at {self.path}")
        self._point({"relations": {name: {} for name in RELATIONS}, "metadata": {"schema_version": str(SCHEMA_VERSION)}})
        return self

    def open(self) -> FactStore:
        """The store, once its version has been checked. Version 3 lacks file_mtimes and gets them."""
        pointer = self._pointer()
        version = int(pointer["metadata"].get("schema_version", 0))
        if version > SCHEMA_VERSION:
            raise StoreError(f"version {version} is newer than {SCHEMA_VERSION}")
        if version < SCHEMA_VERSION:
            pointer["relations"].setdefault("file_mtimes", {})
            pointer["metadata"]["schema_version"] = str(SCHEMA_VERSION)
            self._point(pointer)
        return self

    def open_or_create(self) -> FactStore:
        return self.open() if self.exists() else self.create()

    # reading

    def read(self, relation: str) -> DataFrame:
        if relation == "metadata":
            rows = list(self._pointer()["metadata"].items())
            return self.spark.createDataFrame(rows, RELATIONS["metadata"])
        return self._load(relation, self._pointer()["relations"].get(relation, {}))

    def _load(self, relation: str, parts: dict) -> DataFrame:
        schema = RELATIONS[relation]
        folders = sorted({f for some in parts.values() for f in some})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def metadata(self, key: str) -> str | None:
        return self._pointer()["metadata"].get(key)

    def set_metadata(self, key: str, value: str) -> None:
        pointer = self._pointer()
        pointer["metadata"][key] = value
        self._point(pointer)

    # writing

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, relation: str, df: DataFrame, only: list[int] | None = None) -> dict[str, list[str]]:
        """Write the rows; the folders of each bucket that has rows."""
        schema, folder = RELATIONS[relation], f"v/{uuid.uuid4().hex}"
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows = df.select(*columns)
        if relation not in _BY_FILE:
            rows.write.parquet(f"{self.path}/{folder}/all")
            return {"all": [f"{folder}/all"]}
        bucketed = rows.withColumn("bucket", self._bucket(_BY_FILE[relation]))
        # dealt by bucket, a large bucket in as many pieces as it has advisory sizes: no task holds a whole one
        bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", _BY_FILE[relation]).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = range(self.buckets) if only is None else only
        jvm, _, fs = self._fs()
        return {str(b): [f"{folder}/bucket={b}"] for b in there if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/bucket={b}"))}

    def overwrite(self, **relations: DataFrame) -> None:
        """Whole relations in place of what they held."""
        pointer = self._pointer()
        for name, df in relations.items():
            pointer["relations"][name] = self._write(name, df)
        self._point(pointer)

    def append(self, relation: str, df: DataFrame) -> None:
        """More rows. Only they are written, but for buckets in too many pieces, which become one."""
        pointer = self._pointer()
        parts = pointer["relations"].get(relation, {})
        full = {b: f for b, f in parts.items() if len(f) >= FOLDERS}
        added = self._write(relation, df)
        merged = {b: parts.get(b, []) + added.get(b, []) for b in parts.keys() | added.keys()}
        if full:
            merged |= self._write(relation, self._load(relation, {b: merged[b] for b in full}))
        pointer["relations"][relation] = merged
        self._point(pointer)

    def delete_where(self, relation: str, condition: str) -> None:
        """The relation without the rows that the SQL condition is true for."""
        kept = self.read(relation).filter(f"({condition}) is not true")
        self.overwrite(**{relation: kept})

    def replace_files(self, files: DataFrame, fresh: dict[str, DataFrame], metadata: dict[str, str] | None = None) -> None:
        """The facts of files (column path) go and fresh ones come, in all relations at once.

        Only the buckets of these files are read and written again; their number is bounded.
        """
        pointer = self._pointer()
        touched = sorted(r[0] for r in files.select(self._bucket("path")).distinct().collect())
        for name, column in _BY_FILE.items():
            if name == "file_mtimes" and name not in fresh:
                continue
            parts = pointer["relations"].get(name, {})
            old = self._load(name, {b: f for b, f in parts.items() if int(b) in touched})
            kept = old.join(files.select(F.col("path").alias(column)).distinct(), column, "left_anti")
            new = kept.select(*RELATIONS[name].names)
            if name in fresh:
                new = new.unionByName(fresh[name], allowMissingColumns=True)
            written = self._write(name, new, touched)
            pointer["relations"][name] = {b: f for b, f in parts.items() if int(b) not in touched} | written
        pointer["metadata"] |= metadata or {}
        self._point(pointer)

    def clear_files(self, files: DataFrame) -> None:
        self.replace_files(files, {})

    def set_mtimes(self, rows: DataFrame) -> None:
        self.overwrite(file_mtimes=upsert(self.read("file_mtimes"), rows, "path"))

    def mtime_of(self, path: str) -> int | None:
        """A file's recorded time; only its bucket is read."""
        parts = self._pointer()["relations"].get("file_mtimes", {})
        own = self.spark.createDataFrame([(path,)], "path string").select(self._bucket("path")).first()[0]
        row = self._load("file_mtimes", {b: f for b, f in parts.items() if b == str(own)}).filter(F.col("path") == path).first()
        return None if row is None else row["mtime"]

    def tracked_files(self) -> DataFrame:
        return self.read("file_mtimes").select("path").orderBy("path")

    def next_id(self, relation: str) -> int:
        return (self.read(relation).agg(F.max("id")).first()[0] or 0) + 1


def _alive(pid: int) -> bool:
    try:
        os.kill(int(pid), 0)
    except PermissionError:
        return True
    except (OSError, ValueError):
        return False
    return int(pid) > 0

"""Several projects at once: which are registered, which one a question is about, what each defines."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import FactStore
from .search import matching


class ProjectRegistry:
    """The registered project roots, kept in a small JSON file, and the fact store of each.

    Only registered roots are ever answered for: a path outside of them is refused, not opened.
    """

    def __init__(self, spark: SparkSession, path: str, store_name: str = ".symtrail"):
        self.spark, self.path, self.store_name = spark, path, store_name
        self._stores: dict[str, FactStore] = {}

    def list(self) -> list[str]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return sorted(json.load(f)["projects"])
        except (OSError, ValueError, KeyError):
            return []

    def _save(self, roots: list[str]) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        new = f"{self.path}.{os.getpid()}"
        with open(new, "w", encoding="utf-8") as f:
            json.dump({"projects": sorted(set(roots))}, f)
        os.replace(new, self.path)

    def register(self, root: str) -> str:
        """Add a root that has a store; one that is registered already stays as it is."""
        root = os.path.realpath(root)
        if root not in self.list():
            self.store(root)
            self._save([*self.list(), root])
        return root

    def unregister(self, root: str) -> bool:
        """Whether the root was registered; its path need no longer exist."""
        root, roots = os.path.realpath(root), self.list()
        self._stores.pop(root, None)
        if root in roots:
            self._save([r for r in roots if r != root])
        return root in roots

    def store(self, root: str) -> FactStore:
        if root not in self._stores:
            self._stores[root] = FactStore(self.spark, os.path.join(root, self.store_name)).open()
        return self._stores[root]

    def reload(self, root: str) -> FactStore:
        """The root's store, opened anew."""
        self._stores.pop(os.path.realpath(root), None)
        return self.store(os.path.realpath(root))

    def containing(self, path: str) -> str | None:
        """The registered root that holds a path, the innermost of several."""
        path = os.path.realpath(path)
        held = [r for r in self.list() if path == r or path.startswith(r.rstrip("/") + "/")]
        return max(held, key=len, default=None)

    def resolve(self, root: str | None = None, file: str | None = None, cwd: str | None = None) -> list[str]:
        """The roots that a question is about: of the given root or what holds it (none if it is not
        registered), else of the file, else of the working directory, else all."""
        if root is not None:
            held = self.containing(root)
            return [] if held is None else [held]
        for hint in (file, cwd or os.getcwd()):
            if hint is not None and (held := self.containing(hint)) is not None:
                return [held]
        return self.list()

    def symbols(self, roots: list[str] | None = None) -> DataFrame:
        """The symbols of several projects, with the project of each."""
        every = None
        for root in self.list() if roots is None else roots:
            own = self.store(root).read("symbols").withColumn("project", F.lit(root))
            every = own if every is None else every.unionByName(own)
        if every is None:
            raise ValueError("no project is registered")
        return every


def definitions(symbols: DataFrame, name: str, project: str = "project") -> DataFrame:
    """In each project the first symbol of that qualified name; where there is none, those of the
    first ten hits of the pattern search that have the name as a whole."""
    first = Window.partitionBy(project).orderBy("id")
    exact = symbols.filter(F.col("qualified") == name).withColumn("place", F.row_number().over(first)).filter("place = 1")
    hits = matching(symbols, name).withColumn("place", F.row_number().over(first)).filter("place <= 10")
    named = hits.filter((F.col("name") == name) | (F.col("qualified") == name))
    return exact.unionByName(named.join(exact.select(project), project, "left_anti").select(*exact.columns)).drop("place")




def type_summary(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """symbols, files, typed symbols, types with members and their members."""
    own = symbols.agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"), F.count_distinct(F.when(F.col("type_signature").isNotNull(), F.col("qualified"))).alias("typed"))
    held = members.agg(F.count_distinct("type_name").alias("types"), F.count("*").alias("members"))
    return own.join(F.broadcast(held), F.lit(True))

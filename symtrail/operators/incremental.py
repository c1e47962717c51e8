"""Incremental maintenance: what is stale, and facts with some files or types replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_files(tracked: DataFrame, disk: DataFrame) -> DataFrame:
    """path, reason: deleted (tracked only), new (on disk only), modified (mtimes differ at all).
    Both have path and mtime in seconds."""
    t, d = tracked.select("path", F.col("mtime").alias("old_")), disk.select("path", F.col("mtime").alias("new_"))
    both = t.join(d, "path", "full")
    reason = F.when(F.col("new_").isNull(), "deleted").when(F.col("old_").isNull(), "new").when(F.col("old_") != F.col("new_"), "modified")
    return both.select("path", reason.alias("reason")).filter("reason is not null")


def without_files(facts: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """facts without the rows of the given files (column path)."""
    return facts.join(files.select(F.col("path").alias(column)).distinct(), column, "left_anti").select(*facts.columns)


def replace_files(facts: DataFrame, fresh: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """facts with all rows of the given files taken out and fresh put in."""
    return without_files(facts, files, column).unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in, each in place of the one with its key."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def update_types(symbols: DataFrame, types: DataFrame) -> DataFrame:
    """symbols with the type of each qualified name in types (qualified, type_signature), for all
    overloads; these then count as semantic."""
    new = types.groupBy("qualified").agg(F.max("type_signature").alias("new_"))
    joined = symbols.join(new, "qualified", "left")
    changed = joined.withColumns({"type_signature": F.coalesce("new_", "type_signature"), "source": F.when(F.col("new_").isNotNull(), "semantic").otherwise(F.col("source"))})
    return changed.select(*symbols.columns)


def without_members(members: DataFrame, type_name: str) -> DataFrame:
    return members.filter(F.col("type_name") != type_name)


def is_stale(files: DataFrame, store_mtime: int) -> DataFrame:
    """files (path, mtime) that changed after the store was written."""
    return files.filter(F.col("mtime") > store_mtime)

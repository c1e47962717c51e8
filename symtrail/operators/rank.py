"""Counts, ranking and project maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extension, kind_weight, kind_weight_in_file, visibility_weight
from .lookup import significant

#: Weights of the file diversity, the kind and the visibility in a score.
DIVERSITY, KIND, VISIBILITY = 1.0, 0.3, 0.1


def reference_counts(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """qualified, file_diversity, total_refs for each qualified name.

    A ref counts for a symbol whose name or qualified name it equals, and once for each overload.
    The condition is an OR, which no hash join takes: both keys are exploded instead, and refs are
    added up by (name, file) before the join, so a hot name brings a row for each file and no more.
    """
    keys = symbols.select("qualified", F.explode(F.array_distinct(F.array("name", "qualified"))).alias("key"))
    keys = keys.groupBy("qualified", "key").agg(F.count("*").alias("overloads"))
    counts = refs.groupBy(F.col("name").alias("key"), "file").agg(F.count("*").alias("n"))
    by_file = keys.join(counts, "key").groupBy("qualified", "file").agg(F.sum(F.col("n") * F.col("overloads")).alias("n"))
    return by_file.groupBy("qualified").agg(F.count("*").alias("file_diversity"), F.sum("n").alias("total_refs"))


def symbol_reference_counts(refs: DataFrame, name: str, qualified: str) -> DataFrame:
    own = refs.filter(F.col("name").isin(name, qualified))
    return own.agg(F.count_distinct("file").alias("file_diversity"), F.count("*").alias("total_refs"))


def score(diversity: Column, total: Column, kind: Column, visibility: Column) -> Column:
    base = diversity * DIVERSITY + kind_weight(kind) * KIND + visibility_weight(visibility) * VISIBILITY
    return base + F.when(total > 0, F.log(F.greatest(total, F.lit(1)).cast("double")) * 0.1).otherwise(0.0)


def with_counts(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row for each qualified name (of overloads the first) with counts and score."""
    first = symbols.groupBy("qualified").agg(F.min_by(F.struct("id", "name", "kind", "file", "line", "visibility"), "id").alias("s")).select("qualified", "s.*")
    counted = first.join(reference_counts(symbols, refs), "qualified", "left").fillna(0, ["file_diversity", "total_refs"])
    return counted.withColumn("score", score(F.col("file_diversity"), F.col("total_refs"), F.col("kind"), F.col("visibility")))


def rank_symbols(symbols: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """The most widely used symbols: by file diversity, kind, visibility, refs; ties by name."""
    return with_counts(symbols, refs).orderBy(F.desc("file_diversity"), F.desc(kind_weight(F.col("kind"))), F.desc(visibility_weight(F.col("visibility"))), F.desc("total_refs"), "qualified").limit(limit)


def rank_per_file(symbols: DataFrame, refs: DataFrame, per_file: int, max_files: int | None = None) -> DataFrame:
    """The first symbols of each file, in place order; of the first max_files files by name."""
    counts = symbols.select("id", "name", "qualified", "kind", "file").join(reference_counts(symbols, refs), "qualified", "left").fillna(0, ["file_diversity", "total_refs"])
    w = Window.partitionBy("file").orderBy(F.desc("file_diversity"), F.desc(kind_weight_in_file(F.col("kind"))), F.desc("total_refs"), "qualified", "id")
    top = counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_file)
    if max_files is None:
        return top
    files = symbols.select("file").distinct().orderBy("file").limit(max_files)
    return top.join(F.broadcast(files), "file", "left_semi") if max_files <= 10_000 else top.join(files, "file", "left_semi")


def group_by_file(ranked: DataFrame) -> DataFrame:
    """file, symbols: the ranked symbols of each file, in their order."""
    return ranked.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(-F.col("file_diversity"), -F.col("total_refs"), "qualified"))).alias("symbols")).orderBy("file")


def project_map(symbols: DataFrame, per_file: int = 20) -> DataFrame:
    """Every file's significant symbols, at most per_file of them, and how many more there are."""
    w = Window.partitionBy("file").orderBy("line", "id")
    every = Window.partitionBy("file")
    listed = significant(symbols).withColumns({"place": F.row_number().over(w), "n": F.count("*").over(every)})
    return listed.filter(F.col("place") <= per_file).select("file", "place", "qualified", "kind", "line", F.greatest(F.col("n") - per_file, F.lit(0)).alias("more"))


def describe(symbols: DataFrame, refs: DataFrame, detail: str, limit: int = 50) -> DataFrame:
    """The project at one of three levels: summary, normal, full; any other word means summary."""
    if detail == "normal":
        return rank_per_file(symbols, refs, 5, limit)
    return project_map(symbols) if detail == "full" else rank_symbols(symbols, refs, limit)


def totals(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"), F.count_distinct("qualified").alias("names"))


# The language that an extension tells.
LANGUAGE_OF = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp",
    "fs": "fsharp", "fsi": "fsharp", "fsx": "fsharp", "go": "go", "hx": "haxe", "java": "java", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "kt": "kotlin", "kts": "kotlin", "m": "objc", "mm": "objc",
    "php": "php", "py": "python", "pyi": "python", "rb": "ruby", "rs": "rust", "swift": "swift", "ts": "typescript", "tsx": "typescript",
}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(table, F.lower(extension(path)))


def extension_histogram(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(extension(F.col(path)).alias("ext")).agg(F.count("*").alias("files"))


def primary_language(files: DataFrame, path: str = "path") -> DataFrame:
    counts = files.groupBy(language_of(F.col(path)).alias("language")).agg(F.count("*").alias("files"))
    return counts.filter("language is not null").orderBy(F.desc("files"), "language").limit(1)

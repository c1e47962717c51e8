"""References: who refers to a name, and from within which symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import matches_name, normalise_path, under
from ..schema import CALLABLE


def find_references(refs: DataFrame, name: str) -> DataFrame:
    """Refs to the name itself, or that end in it after a separator."""
    return refs.filter(matches_name(F.col("name"), name))


def find_references_defined(symbols: DataFrame, refs: DataFrame, qualified: str) -> DataFrame:
    """Refs to a defined symbol; none if it is not defined. A ref is its short name (of the first
    overload), its qualified name, an end of that, or a longer path to the short name."""
    targets = symbols.filter(F.col("qualified") == qualified).orderBy("id").limit(1).select(F.col("qualified").alias("target"), F.col("name").alias("short"))
    return references_to(targets, refs)


def suffixes(c: Column) -> Column:
    """What stands after each dot of a name, the longest first."""
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def _key(how: str, c: Column) -> Column:
    return F.struct(F.lit(how).alias("how"), c.alias("text"))


def target_keys(targets: DataFrame) -> DataFrame:
    """target, key_ for every target (target, short). A ref means a target if it is the short name,
    the qualified name or an end of that, or ends in the short name after a dot: that is, if one of
    the ref's keys (its whole name, or an end of it) equals one of these."""
    wholes = F.array_distinct(F.concat(F.array("short", "target"), suffixes(F.col("target"))))
    keys = F.concat(F.transform(wholes, lambda k: _key("whole", k)), F.array(_key("end", F.col("short"))))
    return targets.select("target", F.explode(keys).alias("key_")).distinct()


def split_keys(targets: DataFrame) -> DataFrame:
    """short, target, key_: target_keys() with those of a short name once for all of its targets, with
    a null target. What ends in the short name has it as its end, so few targets have more keys."""
    wholes = F.array_distinct(F.concat(F.array("target"), suffixes(F.col("target"))))
    more = F.filter(wholes, lambda k: (k != F.col("short")) & ~k.endswith(F.concat(F.lit("."), F.col("short"))))
    alike = targets.select("short").distinct().select("short", F.lit(None).cast("string").alias("target"), F.explode(F.array(_key("whole", F.col("short")), _key("end", F.col("short")))).alias("key_"))
    return alike.unionByName(targets.select("short", "target", F.explode(F.transform(more, lambda k: _key("whole", k))).alias("key_")))


def with_keys(refs: DataFrame, name: str = "name") -> DataFrame:
    """refs once for each of its keys; see target_keys()."""
    keys = F.concat(F.array(_key("whole", F.col(name))), F.transform(suffixes(F.col(name)), lambda k: _key("end", k)))
    return refs.withColumn("key_", F.explode(keys))


def references_any(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """The refs to any of the targets: a semi-join of the distinct names, and one of the refs."""
    names = with_keys(refs.select("name").distinct()).join(target_keys(targets).select("key_"), "key_", "left_semi").select("name").distinct()
    return refs.join(names, "name", "left_semi").select(*refs.columns)


def references_to(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with target for every target (target, short) that they refer to.

    The rule is decided on distinct names by equality of keys; refs then join by name. Where the
    target does not matter, references_any() makes no pairs.
    """
    names = with_keys(refs.select("name").distinct()).join(target_keys(targets), "key_").select("name", "target").distinct()
    return refs.join(names, "name").select(*refs.columns, "target")


def containing_symbol(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with container, the function or member of the same file that begins last at or before
    the ref's line (of equals the later one); null if there is none.

    An as-of join: symbols and refs of a file are put in order together and the last symbol seen is
    carried on. Linear in both, unlike a join on file and line that multiplies them.
    """
    starts = symbols.filter(F.col("kind").isin(*CALLABLE)).select("file", "line", F.lit(0).alias("side_"), F.col("id").alias("order_"), F.struct("qualified", "id").alias("symbol_"))
    wanted = refs.select("file", "line", F.lit(1).alias("side_"), F.col("id").alias("order_"), F.struct(*[c for c in refs.columns]).alias("ref_"))
    both = starts.unionByName(wanted, allowMissingColumns=True)
    w = Window.partitionBy("file").orderBy("line", "side_", "order_").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("in_", F.last("symbol_", ignorenulls=True).over(w)).filter("side_ = 1")
    return carried.select("ref_.*", F.col("in_.qualified").alias("container"))


def refs_resolved_or_external(symbols: DataFrame, refs: DataFrame, file: str) -> DataFrame:
    """The refs of a file with the file that defines each, `<external>` if none does."""
    first = symbols.groupBy(F.col("qualified").alias("name")).agg(F.min_by("file", "id").alias("defined_in"))
    own = refs.filter(F.col("file") == file)
    return own.join(first, "name", "left").select("name", "file", "line", "column", F.coalesce("defined_in", F.lit("<external>")).alias("defined_in"))


def with_lines(refs: DataFrame, sources: DataFrame, context: int = 0, numbered: bool = False, root: str | None = None) -> DataFrame:
    """refs with context: the lines around each, joined by newlines. sources: path, content. With a
    root, files outside of it are never shown, however their paths are written."""
    if root is not None:
        sources = sources.filter(under(normalise_path(F.col("path")), root.rstrip("/")))
    lines = sources.select(F.col("path").alias("file"), F.split("content", "\n").alias("lines_"))
    joined = refs.join(lines, "file", "left")
    first = F.greatest(F.col("line") - context, F.lit(1))
    around = F.slice("lines_", first, F.col("line") + context - first + 1)
    if numbered:
        around = F.transform(around, lambda x, i: F.format_string("%4d | %s", i + first, x))
    return joined.withColumn("context", F.when(F.col("line") <= F.size("lines_"), F.array_join(around, "\n"))).drop("lines_")

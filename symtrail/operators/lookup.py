"""Point lookups, projections and filters over the fact relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_path, fold_ascii, fold_ascii_text, under

SIGNIFICANT = ("class", "module", "interface", "record", "union")


def find_all(symbols: DataFrame, qualified: str) -> DataFrame:
    """Every overload, in the order in which they were added."""
    return symbols.filter(F.col("qualified") == qualified).orderBy("id")


def find_first(symbols: DataFrame, qualified: str) -> DataFrame:
    """The overload added first, as stores answer."""
    return find_all(symbols, qualified).limit(1)


def get_last(symbols: DataFrame, qualified: str) -> DataFrame:
    """The overload added last, as in-memory indexes answer."""
    return symbols.filter(F.col("qualified") == qualified).orderBy(F.desc("id")).limit(1)


def get_absolute(symbols: DataFrame, qualified: str, root: str) -> DataFrame:
    return get_last(symbols, qualified).withColumn("file", absolute_path(F.col("file"), root))


def in_file(facts: DataFrame, file: str) -> DataFrame:
    """The symbols or refs of a file, in order of emission."""
    return facts.filter(F.col("file") == file).orderBy("id")


def symbols_in_file_indexed(symbols: DataFrame, file: str) -> DataFrame:
    """Every definition, in whatever file, of each name that the file defines."""
    names = symbols.filter(F.col("file") == file).select("qualified").distinct()
    return symbols.join(names, "qualified", "left_semi")


def opens_for_file(opens: DataFrame, file: str) -> DataFrame:
    return opens.filter(F.col("file") == file).orderBy("ord", "module_path").select("module_path", "ord")


def symbol_type(symbols: DataFrame, qualified: str) -> DataFrame:
    known = symbols.filter((F.col("qualified") == qualified) & F.col("type_signature").isNotNull())
    return known.orderBy("id").limit(1).select("qualified", "type_signature")


def members_of(members: DataFrame, type_name: str) -> DataFrame:
    return members.filter(F.col("type_name") == type_name).orderBy("id")


def member(members: DataFrame, type_name: str, member_name: str) -> DataFrame:
    return members.filter((F.col("type_name") == type_name) & (F.col("member_name") == member_name)).orderBy("id").limit(1)


def symbols_in_module(symbols: DataFrame, module: str) -> DataFrame:
    return symbols.filter(F.col("qualified").startswith(module + ".") | (F.col("qualified") == module))


def contains_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.agg(F.coalesce(F.bool_or(F.col("file") == file), F.lit(False)).alias("contains_file"))


def visible_files(files: DataFrame, order: DataFrame, file: str) -> DataFrame:
    """path: the files that come before `file` in the compile order; all files if it is not in the
    order, or if there is none. order: path, ord, a short table."""
    own = order.filter(F.col("path") == file).agg(F.min("ord").alias("own_ord"))
    placed = files.select("path").distinct().join(order.groupBy("path").agg(F.min("ord").alias("ord")), "path", "left")
    return placed.join(F.broadcast(own), F.col("own_ord").isNull() | (F.col("ord") < F.col("own_ord"))).select("path")


def can_reference(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """pairs (from_file, to_file) with can_reference: whether to_file comes strictly before in the
    compile order; true if either has no place in it."""
    places = order.groupBy("path").agg(F.min("ord").alias("ord"))
    source = places.select(F.col("path").alias("from_file"), F.col("ord").alias("from_ord"))
    target = places.select(F.col("path").alias("to_file"), F.col("ord").alias("to_ord"))
    known = pairs.join(source, "from_file", "left").join(target, "to_file", "left")
    return known.select("from_file", "to_file", F.coalesce(F.col("to_ord") < F.col("from_ord"), F.lit(True)).alias("can_reference"))


def subclasses(symbols: DataFrame, parent: str) -> DataFrame:
    """Whose parent is the name itself, then those with a leading `::`; one level only."""
    found = symbols.filter(F.col("parent").isin(parent, f"::{parent}"))
    return found.orderBy((F.col("parent") != parent).cast("int"), "id")


def implements(names: Column, interface: str) -> Column:
    """An element of the array begins with the name, without regard to ASCII case; % and _ are wild."""
    pattern = fold_ascii_text(interface).replace("~", "~~") + "%"
    return F.exists(names, lambda x: F.like(fold_ascii(x), F.lit(pattern), F.lit("~")))


def implementers(symbols: DataFrame, interface: str) -> DataFrame:
    return symbols.filter(implements(F.col("implements"), interface))


def refs_under(refs: DataFrame, path: str) -> DataFrame:
    return refs.filter(under(F.col("file"), path))


def of_language(symbols: DataFrame, language: str) -> DataFrame:
    return symbols.filter(F.col("language") == language)


def significant(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin(*SIGNIFICANT))


def all_ordered(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("file", "line", "id")


def distinct_files(symbols: DataFrame) -> DataFrame:
    return symbols.select("file").distinct().orderBy("file")


def project_for_file(files: DataFrame, projects: DataFrame) -> DataFrame:
    """file, root: the longest project root that holds the file. Each file looks up its ancestors by
    equality, so no range join is needed."""
    parts = F.split("file", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("file", F.explode(ancestors).alias("root"))
    return up.join(projects.select("root"), "root").groupBy("file").agg(F.max_by("root", F.length("root")).alias("root"))

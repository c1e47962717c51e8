"""What an editor asks: completion, import order and places, hover, diagnostics, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_kind, module_prefix
from .lookup import in_file, symbols_in_file_indexed
from .rank import language_of
from .search import cascade, search, search_ranked

# The keywords of F#.
KEYWORDS = (
    "let rec and in fun function match with if then else elif for while do to downto type module namespace open val mutable inline private internal public "
    "static member override abstract default new inherit interface class struct as base this try finally raise return return! yield yield! do! let! match! "
    "when null true false async use use! lazy seq assert begin end done of exception extern global upcast downcast fixed"
).split()


def keyword_completions(spark, prefix: str = "") -> DataFrame:
    """label: the keywords that begin with the prefix; a fixed, short table."""
    return spark.createDataFrame([(k,) for k in KEYWORDS if k.startswith(prefix)], "label string")


def in_scope(qualified: Column, file: str, opens: Column) -> Column:
    """Whether a symbol can be named without its module: it has none, the module or one above it is
    imported (opens: an array), or one of the module's parts, or its end, is the file's name."""
    module = F.coalesce(module_prefix(qualified), F.lit(""))
    stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    opened = F.exists(opens, lambda o: (module == o) | module.startswith(F.concat(o, F.lit("."))))
    return (module == "") | opened | module.endswith(stem) | F.array_contains(F.split(module, r"\."), stem)


def symbol_completions(symbols: DataFrame, opens: DataFrame, file: str, prefix: str = "", limit: int = 50) -> DataFrame:
    """label, insert_text, detail: without a prefix the symbols of the file and of the modules that it
    imports, else the first hits of the ranked search. insert_text is the qualified name of what is
    not in scope."""
    own = opens.filter(F.col("file") == file)
    listed = own.agg(F.collect_set("module_path").alias("opens_"))  # the imports of one file
    if prefix:
        found = search_ranked(symbols, prefix).limit(limit)
    else:
        modules = own.select("module_path").distinct()
        parts = F.split("qualified", r"\.")
        ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
        opened = symbols.withColumn("module_path", F.explode(ups)).join(modules, "module_path", "left_semi").select(*symbols.columns).distinct()
        found = symbols_in_file_indexed(symbols, file).select(*symbols.columns).unionByName(opened).dropDuplicates(["id"]).orderBy("id").limit(limit)
    detail = F.concat(display_kind(F.col("kind")), F.lit(" ("), "qualified", F.lit(")"))
    scoped = found.join(F.broadcast(listed), F.lit(True)).withColumn("scoped_", in_scope(F.col("qualified"), file, F.col("opens_")))
    return scoped.select(F.col("name").alias("label"), F.when(~F.col("scoped_"), F.col("qualified")).alias("insert_text"), detail.alias("detail"), "id")


def member_completions(members: DataFrame, type_name: str) -> DataFrame:
    return members.filter(F.col("type_name") == type_name).select(F.col("member_name").alias("label"), "kind", F.coalesce("member_type", F.lit("")).alias("detail"))


def organised_opens(content: Column) -> Column:
    """The imports of a text in order, by depth and then by name without regard to case; null with
    fewer than two, or if they are in order."""
    lines = F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x))
    names = F.transform(F.filter(lines, lambda x: x.startswith("open ")), lambda x: F.trim(F.substring(x, F.lit(6), F.char_length(x))))
    keyed = F.transform(names, lambda n, i: F.struct((F.size(F.split(n, r"\.")) - 1).alias("depth"), F.lower(n).alias("low"), i.alias("i"), n.alias("n")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["n"])
    text = F.array_join(F.transform(ordered, lambda n: F.concat(F.lit("open "), n)), "\n")
    return F.when((F.size(names) >= 2) & (ordered != names), text)


def open_insert_line(content: Column) -> Column:
    """The line, from 0, to put a new import at: after the last import, else after the first module
    or namespace, else the top."""
    lines = F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x))
    places = lambda test: F.filter(F.transform(lines, lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())
    opens = places(lambda x: x.startswith("open "))
    heads = places(lambda x: x.startswith("module ") | x.startswith("namespace "))
    return F.coalesce(F.array_max(opens), F.array_min(heads), F.lit(0))


def hover(symbols: DataFrame, qualified: str) -> DataFrame:
    """qualified, text: the signature, else the known type; none of both gives no row."""
    text = F.coalesce("signature", "type_signature")
    return symbols.filter(F.col("qualified") == qualified).orderBy("id").limit(1).select("qualified", text.alias("text")).filter("text is not null")


def documentation(symbols: DataFrame, name: str) -> DataFrame:
    """qualified, signature, doc: of the qualified name itself, else of the first hit of the pattern
    search; a symbol without a doc has a row with none."""
    columns = ["qualified", "signature", "doc"]
    exact = symbols.filter(F.col("qualified") == name).orderBy("id").limit(1).select(*columns)
    return cascade(exact, search(symbols, name, 1).select(*columns)).drop("branch")


def diagnostics_of(diagnostics: DataFrame, file: str) -> DataFrame:
    return diagnostics.filter((F.col("file") == file) & (F.col("severity") == "error"))


def definition_at(symbols: DataFrame, file: str, line: int) -> DataFrame:
    """The symbols that begin on a line of a file."""
    return in_file(symbols, file).filter(F.col("line") == line)


def item_text(symbols: DataFrame) -> DataFrame:
    """qualified, text: the signature, else the first line of the doc, else kind and name."""
    text = F.coalesce("signature", F.substring_index("doc", "\n", 1), F.concat_ws(" ", "kind", "name"))
    return symbols.select("id", "qualified", text.alias("text"))


def health(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """check, ok, detail: what a first look at a store tells."""
    counts = symbols.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    known = files.agg(F.count_if(language_of(F.col("path")).isNotNull()).alias("known"), F.count("*").alias("all"))
    row = counts.join(F.broadcast(known), F.lit(True))
    checks = F.array(
        F.struct(F.lit("symbols").alias("check"), (F.col("n") > 0).alias("ok"), F.col("n").cast("string").alias("detail")),
        F.struct(F.lit("files").alias("check"), (F.col("files") > 0).alias("ok"), F.col("files").cast("string").alias("detail")),
        F.struct(F.lit("languages").alias("check"), (F.col("known") == F.col("all")).alias("ok"), F.format_string("%d of %d", "known", "all").alias("detail")),
    )
    return row.select(F.explode(checks).alias("c")).select("c.*")

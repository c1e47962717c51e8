"""Extraction: source text to symbols, refs, opens and diagnostics, by language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.rank import LANGUAGE_OF
from ..scratch import materialise
from . import generic, python

_S, _I = T.StringType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SYMBOL = _struct(
    ("name", _S), ("qualified", _S), ("kind", _S), ("line", _I), ("column", _I), ("end_line", _I), ("end_column", _I), ("visibility", _S),
    ("parent", _S), ("mixins", T.ArrayType(_S)), ("attributes", T.ArrayType(_S)), ("implements", T.ArrayType(_S)), ("doc", _S), ("signature", _S),
)
REF = _struct(("name", _S), ("line", _I), ("column", _I))
DIAGNOSTIC = _struct(("severity", _S), ("message", _S), ("line", _I))
RESULT = _struct(("path", _S), ("mtime", T.LongType()), ("language", _S), ("symbols", T.ArrayType(SYMBOL)), ("refs", T.ArrayType(REF)), ("opens", T.ArrayType(_S)), ("diagnostics", T.ArrayType(DIAGNOSTIC)))


def extract_text(path: str, content: str, max_depth: int = 500) -> dict | None:
    """What one file holds; None for a language that is not known."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    language = LANGUAGE_OF.get(extension)
    if language is None:
        return None
    found = python.extract(content, max_depth) if language == "python" else generic.extract(content, language, max_depth)
    return {"language": language} | found


def extract(sources: DataFrame, max_depth: int = 500) -> DataFrame:
    """One row of arrays for each source file (path, mtime, content); unreadable ones give none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, mtime, content in zip(batch["path"], batch["mtime"], batch["content"], strict=True):
                found = None if content is None else extract_text(path, content, max_depth)
                if found is not None:
                    out.append({"path": path, "mtime": mtime} | found)
            yield pd.DataFrame(out, columns=RESULT.names)

    return sources.select("path", "mtime", "content").mapInPandas(rows, RESULT)


def facts(extracted: DataFrame, first_id: int = 1) -> dict[str, DataFrame]:
    """symbols, refs, opens, file_mtimes and diagnostics of extracted files, which are read once.

    Ids go by file and then by emission. Files are dealt out by ranges of their paths; each range's
    counts are added up, one row a range, and the files of a range start where the ranges before it
    end. So neither the facts nor the files are ever sorted in one task.
    """
    extracted = materialise(extracted)
    counts = ("n_symbols", "n_refs", "n_opens")
    sizes = extracted.select("path", F.size("symbols").alias("n_symbols"), F.size("refs").alias("n_refs"), F.size("opens").alias("n_opens"))
    sizes = materialise(sizes.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    totals = sizes.groupBy("part").agg(*[F.sum(c).alias(f"all_{c}") for c in counts])
    offsets = totals.select("part", *[(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)) + first_id).alias(f"all_{c}") for c in counts])
    within = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("path", "part", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in counts])
    starts = placed.join(F.broadcast(offsets), "part").select("path", *[(F.col(c) + F.col(f"all_{c}")).alias(c) for c in counts])
    based = extracted.join(starts, "path")
    symbols = based.select((F.col("path")).alias("file"), "language", "n_symbols", F.posexplode("symbols").alias("at", "s")).select((F.col("n_symbols") + F.col("at")).alias("id"), "s.*", "file", "language", F.lit("syntactic").alias("source"))
    refs = based.select(F.col("path").alias("file"), "n_refs", F.posexplode("refs").alias("at", "r")).select((F.col("n_refs") + F.col("at")).alias("id"), "r.*", "file")
    opens = based.select(F.col("path").alias("file"), "n_opens", F.posexplode("opens").alias("at", "module_path")).select((F.col("n_opens") + F.col("at")).alias("id"), "file", "module_path", (F.col("at") + 1).alias("ord"))
    diagnostics = extracted.select(F.col("path").alias("file"), F.explode("diagnostics").alias("d")).select("file", "d.*")
    return {"symbols": symbols, "refs": refs, "opens": opens, "file_mtimes": extracted.select("path", "mtime"), "diagnostics": diagnostics}

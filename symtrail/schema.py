"""The fact relations: symbols, refs, opens, members, file_mtimes, metadata."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 4
KINDS = ("module", "function", "value", "type", "record", "union", "interface", "class", "member")
CALLABLE = ("function", "member")
VISIBILITIES = ("public", "internal", "private")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _L, _A = T.StringType(), T.IntegerType(), T.LongType(), T.ArrayType(T.StringType())
SYMBOLS = _struct(
    ("id", _L, False), ("name", _S, False), ("qualified", _S, False), ("kind", _S, False), ("type_signature", _S, True),
    ("file", _S, False), ("line", _I, False), ("column", _I, False), ("end_line", _I, True), ("end_column", _I, True),
    ("visibility", _S, True), ("source", _S, True), ("language", _S, True), ("parent", _S, True), ("mixins", _A, True),
    ("attributes", _A, True), ("implements", _A, True), ("doc", _S, True), ("signature", _S, True),
)
REFS = _struct(("id", _L, False), ("name", _S, False), ("file", _S, False), ("line", _I, False), ("column", _I, False))
#: ord is the import's place among those of its file, from 1, not a line.
OPENS = _struct(("id", _L, False), ("file", _S, False), ("module_path", _S, False), ("ord", _I, False))
MEMBERS = _struct(("id", _L, False), ("type_name", _S, False), ("member_name", _S, False), ("member_type", _S, True), ("kind", _S, False))
FILE_MTIMES = _struct(("path", _S, False), ("mtime", _L, False))
METADATA = _struct(("key", _S, False), ("value", _S, True))
DIAGNOSTICS = _struct(("file", _S, False), ("severity", _S, False), ("message", _S, False), ("line", _I, True))
RELATIONS = {"symbols": SYMBOLS, "refs": REFS, "opens": OPENS, "members": MEMBERS, "file_mtimes": FILE_MTIMES, "metadata": METADATA}

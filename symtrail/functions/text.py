"""Column functions over names, paths, patterns and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KINDS, VISIBILITIES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(c: Column) -> Column:
    """Lower-cases A-Z only, as pattern matching does here."""
    return F.translate(c, UPPER, UPPER.lower())


def fold_ascii_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, UPPER.lower()))


def glob_to_like(pattern: str) -> str:
    """`*` and `?` become % and _; literal % and _ stay wildcards."""
    return pattern.replace("*", "%").replace("?", "_")


def like(c: Column, pattern: str) -> Column:
    """LIKE without regard to ASCII case; no escape character (~ is doubled as Spark needs one)."""
    return F.like(fold_ascii(c), F.lit(fold_ascii_text(pattern).replace("~", "~~")), F.lit("~"))


def matches_name(c: Column, name: str) -> Column:
    """The name itself, or it as the last segment after `.`, `::` or a backslash."""
    return (c == name) | like(c, f"%.{name}") | like(c, f"%::{name}") | like(c, f"%\\{name}")


def module_prefix(qualified: Column) -> Column:
    """What stands before the last dot; null without a dot."""
    return F.when(qualified.contains("."), F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1))


def last_segment(qualified: Column) -> Column:
    return F.regexp_extract(qualified, r"([^.:\\#]*)$", 1)


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def absolute_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def under(path: Column, folder: str) -> Column:
    """path is the folder or lies in it, by whole components."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def _case(c: Column, table: dict[str, object], default) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def kind_weight(kind: Column) -> Column:
    """Weight of a kind in ranking; a trait or an enum, as other tools name them, counts as well."""
    return _case(kind, {"module": 5, "class": 4, "interface": 4, "trait": 4, "record": 3, "union": 3, "enum": 3, "type": 2, "function": 2}, 1)


def kind_weight_in_file(kind: Column) -> Column:
    """The weight when ranking within files: types and functions count as little as values."""
    return _case(kind, {"module": 5, "class": 4, "interface": 4, "trait": 4, "record": 3, "union": 3, "enum": 3}, 1)


def visibility_weight(visibility: Column) -> Column:
    return _case(visibility, {"public": 3, "internal": 2}, 1)


def encode_kind(c: Column) -> Column:
    """How a kind is stored: its name in lower case; null for what is no kind."""
    low = F.lower(c)
    return F.when(low.isin(*KINDS), low)


def encode_visibility(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*VISIBILITIES), low)


def encode_member_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("property", "method", "field", "event"), low)


def decode_kind(c: Column) -> Column:
    return F.when(c.isin(*KINDS), c).otherwise(F.lit("value"))


def decode_visibility(c: Column) -> Column:
    return F.when(c.isin("internal", "private"), c).otherwise(F.lit("public"))


def decode_member_kind(c: Column) -> Column:
    return F.when(c.isin("method", "field", "event"), c).otherwise(F.lit("property"))


def display_kind(c: Column) -> Column:
    return F.initcap(decode_kind(c))


def editor_kind(c: Column) -> Column:
    """The number of the kind in the editor protocol."""
    return _case(c, {"module": 2, "function": 12, "value": 13, "type": 5, "record": 23, "union": 10, "interface": 11, "class": 5, "member": 6}, 13)


def normalise_windows_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normalise_path(c: Column) -> Column:
    """Without `.` components, doubled separators, and `x/..` pairs (three levels deep)."""
    out = F.regexp_replace(F.regexp_replace(c, r"/+", "/"), r"(^|/)\.(?=/|$)", "")
    for _ in range(3):
        out = F.regexp_replace(out, r"(^|/)(?!\.\.)[^/]+/\.\.(?=/|$)", "")
    return out


def is_interface_name(name: Column) -> Column:
    return name.rlike("^I[A-Z]")


def exported_name(name: Column) -> Column:
    """Public if the first letter is upper-case, as in Go."""
    return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")


def simple_type_name(signature: Column) -> Column:
    """The type that a signature comes down to: what follows the last arrow, without a wrapping
    list, option, array, seq or ref, and of a generic type the first argument."""
    last = F.trim(F.element_at(F.split(signature, "->"), -1))
    bare = F.regexp_replace(last, r" (list|option|array|seq|ref)$", "")
    inner = F.regexp_extract(bare, r"<([^,>]*)", 1)
    return F.trim(F.when(bare.contains("<"), inner).otherwise(bare))


def word_before(prefix: Column) -> Column:
    """The word that ends where the cursor stands."""
    return F.regexp_extract(prefix, r"([\p{L}\p{N}_!]+)$", 1)


def expression_before_dot(prefix: Column) -> Column:
    return F.regexp_extract(prefix, r"([\p{L}\p{N}_.]+)\.[\p{L}\p{N}_]*$", 1)

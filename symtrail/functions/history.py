"""Version-control text: log lines and commit types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The commit types that a message may begin with.
COMMIT_TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert")


def commit_type(message: Column) -> Column:
    """The type that the message begins with, if `:`, `(` or `!` follows; else null."""
    found = F.regexp_extract(F.trim(message), f"^({'|'.join(COMMIT_TYPES)})[:(!]", 1)
    return F.when(found != "", found)


def log_line(line: Column) -> Column:
    """A struct of `hash|author|date|relative date|message`, whose message may hold pipes; null for
    lines with fewer parts or without a hash of at least seven hexadecimal digits."""
    parts = F.split(line, r"\|")
    message = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "|")
    good = (F.size(parts) >= 5) & F.get(parts, F.lit(0)).rlike("^[0-9A-Fa-f]{7,}$")
    return F.when(
        good,
        F.struct(
            F.get(parts, F.lit(0)).alias("commit"),
            F.get(parts, F.lit(1)).alias("author"),
            F.get(parts, F.lit(2)).alias("date"),
            F.get(parts, F.lit(3)).alias("date_relative"),
            message.alias("message"),
            commit_type(message).alias("commit_type"),
        ),
    )

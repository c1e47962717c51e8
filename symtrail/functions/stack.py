"""Stack traces: one struct for the frame that a line of text holds, by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of frames that are not the user's own code, by language.
FRAMEWORK = {
    "java": ("java.", "javax.", "sun.", "com.sun.", "org.springframework.", "org.apache.", "org.hibernate.", "io.netty."),
    "ruby": ("/gems/", "/ruby/", "/bundler/", "rails/", "activerecord", "activesupport", "actionpack"),
    "python": ("site-packages/", "/lib/python", "django/", "flask/", "werkzeug/", "celery/"),
    "javascript": ("node_modules/", "internal/", "timers.js", "events.js", "module.js"),
    "rust": ("std::", "core::", "alloc::", "tokio::", "hyper::", "<unknown>"),
    "go": ("runtime.", "runtime/", "net/http.", "syscall.", "internal/"),
}
#: The order in which languages are tried.
ORDER = ("rust", "python", "ruby", "java", "javascript", "go")
_NUMBER = r"\d{1,9}"


def is_framework(symbol: Column, file: Column | None, language: str) -> Column:
    """A mark stands in the symbol, or in the lower-cased path."""
    marks = F.lit(False)
    for mark in FRAMEWORK[language]:
        marks = marks | F.coalesce(symbol.contains(mark), F.lit(False))
        if file is not None:
            marks = marks | F.coalesce(F.lower(file).contains(mark.lower()), F.lit(False))
    return marks


def is_header(line: Column) -> Column:
    """Lines that announce an error rather than hold a frame."""
    starts = line.rlike("^(Traceback|Caused by:|panic:|goroutine |thread ')")
    return starts | (line.rlike("(Exception|Error):") & ~line.startswith("at "))


def _part(line: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found)


def _frame(ok: Column, language: str, symbol: Column, file: Column | None = None, line: Column | None = None, column: Column | None = None, user: Column | None = None) -> Column:
    none = F.lit(None)
    user = ~is_framework(symbol, file, language) if user is None else user
    return F.when(
        ok,
        F.struct(
            symbol.alias("symbol"),
            (none if file is None else file).cast("string").alias("file"),
            (none if line is None else line).cast("int").alias("line"),
            (none if column is None else column).cast("int").alias("column"),
            user.alias("is_user_code"),
            F.lit(language).alias("language"),
        ),
    )


def java_frame(line: Column) -> Column:
    """at package.Class.method(File.java:12), (File.java), (Native Method), (Unknown Source)"""
    shape = r"^at ([^( ]*\.[^( ]*)\(([^)]*)\)"
    where = F.regexp_extract(line, shape, 2)
    known = where.rlike(r"\.(java|kt|scala|groovy)(:|$)") | where.isin("Native Method", "Unknown Source")
    file = F.when(where.isin("Native Method", "Unknown Source"), None).otherwise(F.when(where.contains(":"), F.regexp_extract(where, r"^(.*):[^:]*$", 1)).otherwise(where))
    return _frame(line.rlike(shape) & known, "java", F.regexp_extract(line, shape, 1), file, _part(where, rf":({_NUMBER})$", 1))


def ruby_frame(line: Column) -> Column:
    """[from ]path:12:in `method'"""
    shape = rf"^(?:from )?(.*?):({_NUMBER}):in `(.+)'[^']*$"
    return _frame(line.rlike(shape), "ruby", F.regexp_extract(line, shape, 3), F.regexp_extract(line, shape, 1), _part(line, shape, 2))


def python_frame(line: Column) -> Column:
    """File "path", line 12[, in method]"""
    shape = rf'^File [^"]*"([^"]*)".*?, line ({_NUMBER})(?=,|$)'
    method = F.trim(F.regexp_extract(line, r", line [^,]*.*?, in (.*)$", 1))
    named = F.when(line.rlike(r", line .*, in "), method).otherwise("<module>")
    return _frame(line.rlike(shape), "python", named, F.regexp_extract(line, shape, 1), _part(line, shape, 2))


def _place(text: Column) -> tuple[Column, Column, Column, Column]:
    """ok, file, line, column of path:line:column or path:line."""
    three, two = rf"^(.*):({_NUMBER}):([^:]*)$", rf"^([^:]*):({_NUMBER})$"
    has3 = text.rlike(three)
    column = _part(F.regexp_extract(text, three, 3), rf"^({_NUMBER})$", 1)
    return (
        has3 | text.rlike(two),
        F.when(has3, F.regexp_extract(text, three, 1)).otherwise(F.regexp_extract(text, two, 1)),
        F.when(has3, _part(text, three, 2)).otherwise(_part(text, two, 2)),
        F.when(has3, column),
    )


def javascript_frame(line: Column) -> Column:
    """at method (path:1:2) or at path:1:2"""
    body = F.regexp_extract(line, r"^at (.*)$", 1)
    bracket = body.contains("(")
    inner = F.when(bracket, F.regexp_extract(body, r"\(([^)]*)\)", 1)).otherwise(body)
    ok, file, number, column = _place(inner)
    symbol = F.when(bracket, F.trim(F.regexp_extract(body, r"^([^(]*)\(", 1))).otherwise("<anonymous>")
    return _frame(line.startswith("at ") & ok & (~bracket | body.contains(")")), "javascript", symbol, file, number, column)


def rust_frame(line: Column) -> Column:
    """12: path::to::symbol, or at path.rs:1:2"""
    numbered = rf"^\s*({_NUMBER})\s*: (.*)$"
    symbol = F.trim(F.regexp_extract(line, numbered, 2))
    at = F.regexp_extract(F.trim(line), r"^at (.*)$", 1)
    ok, file, number, column = _place(at)
    place = _frame(at.contains(".rs:") & ok & ~line.rlike(numbered), "rust", F.lit("<location>"), file, number, column, F.lit(True))
    return F.coalesce(_frame(line.rlike(numbered) & symbol.contains("::"), "rust", symbol), place)


def go_frame(line: Column) -> Column:
    """package.function(arguments), or /path/file.go:12 +0x1d"""
    symbol = F.regexp_extract(line, r"^([^(]*)\(", 1)
    path = line.rlike(r"^[/.]")
    call = line.contains("(") & ~path & ~(symbol.contains("/") & ~symbol.contains("."))
    bare = F.regexp_replace(line, r" \+0x(?!.* \+0x).*$", "")
    shape = rf"^(.*):({_NUMBER})$"
    place = _frame(path & bare.rlike(shape), "go", F.lit("<location>"), F.regexp_extract(bare, shape, 1), _part(bare, shape, 2), None, F.lit(True))
    return F.coalesce(_frame(call, "go", symbol), place)


PARSERS = {"rust": rust_frame, "python": python_frame, "ruby": ruby_frame, "java": java_frame, "javascript": javascript_frame, "go": go_frame}


def frame(line: Column) -> Column:
    """The frame in a trimmed line by the first language that finds one; null for none or a header.

    Inside a lambda, where languages are tried one by one: as compiled code all of them together
    would pass the size that the JVM takes."""
    one = lambda x: F.when(~is_header(x), F.coalesce(*[PARSERS[name](x) for name in ORDER]))
    return F.get(F.transform(F.array(line), one), F.lit(0))


def parse_traces(traces: DataFrame, key: str = "trace_id", text: str = "text") -> DataFrame:
    """key, line_no, line, frame and detected_language (of the first frame) for every line that is
    neither empty nor a header; frame is null where nothing was recognised."""
    lines = traces.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "raw")).select(key, "line_no", F.trim("raw").alias("line"))
    kept = lines.filter((F.col("line") != "") & ~is_header(F.col("line"))).withColumn("frame", frame(F.col("line")))
    first = kept.filter("frame is not null").groupBy(key).agg(F.min_by("frame.language", "line_no").alias("detected_language"))
    return kept.join(first, key, "left")

"""Name resolution: per language a list of steps in order, all run as one equality join.

Every step turns a name in a file into qualified names that it might mean. All candidates, with their
place in the order of trial, are joined to the symbols at once; the first that exists is the answer.
Scopes and imports that no symbol lies in, and names that no symbol has within a scope, are dropped
before they meet, so candidates are the names times the scopes that count, file by file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import can_reference

# Separator and steps of each language, in the order in which they are tried. A step
# of several rules tries all of them for one import, or one symbol of the file, before the next.
_CLASSES = ("class", "interface", "record")
_TYPES = ("class", "interface")
RULES: dict[str, tuple[str, tuple]] = {
    "fsharp": (".", ("exact", ("members", ("ends",), ()), ("imports", ("join",)), "parents")),
    "ruby": ("::", ("exact", ("members", ("scope",), ("module", "class")))),
    "c": ("::", ("exact", ("members", ("name",), ()))),
    "cpp": ("::", ("exact", ("namespace", _CLASSES, False), ("imports", ("suffix", "join")), ("members", ("name", "scope"), ("class", "record")))),
    "csharp": (".", ("exact", ("namespace", _CLASSES, False), ("imports", ("suffix", "join")), ("members", ("name", "scope"), _CLASSES))),
    "java": (".", ("exact", ("namespace", ("class",), True), ("imports", ("suffix", "join")), ("members", ("name", "scope"), _TYPES))),
    "kotlin": (".", ("exact", ("namespace", ("class",), True), ("imports", ("suffix", "join")), ("members", ("name", "scope"), _TYPES))),
    "php": ("\\", ("exact", ("namespace", _TYPES, False), ("imports", ("suffix", "join")), ("members", ("name", "scope"), _TYPES))),
    "typescript": (".", ("exact", ("members", ("scope",), ("class", "interface", "module")), ("imports", ("join",)), ("members", ("name",), ()))),
    "javascript": (".", ("exact", ("members", ("scope",), ("class", "module")), ("imports", ("join",)), ("members", ("name",), ()))),
    "swift": (".", ("exact", ("members", ("name",), ()), ("imports", ("join",)), ("members", ("scope",), _CLASSES))),
    "objc": (".", ("exact", ("members", ("name",), ()))),
    "haxe": (".", ("exact", ("members", ("name",), ()), ("imports", ("join",)), ("members", ("scope",), ("class", "interface", "type")))),
    "python": (".", ("exact", ("members", ("scope",), ("class", "module")), ("imports", ("join",)))),
    "rust": ("::", ("exact", ("members", ("scope",), ("module", "class", "interface")), ("imports", ("suffix", "join")))),
    "go": (".", ("exact", ("members", ("scope",), ("module", "class", "interface")), ("imports", ("tail", "join")))),
}
NAMES = {"exact": "Qualified", "members": "SameModule", "namespace": "SameModule", "parents": "ParentModule", "imports": "ViaOpen"}
#: Languages whose dotted names are resolved like any other.
UNDOTTED = ("ruby", "c", "objc")


def _parts(text: Column, sep: str) -> Column:
    return F.split(text, F.lit(f"\\Q{sep}\\E"))


def _ups(qualified: Column, sep: str) -> Column:
    """Every scope that encloses a qualified name, the outermost first."""
    parts = _parts(qualified, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def _candidates(step, sep: str, wanted: DataFrame, inner: DataFrame, symbols: DataFrame, opens: DataFrame, scopes: DataFrame) -> DataFrame:
    """name, from_file, candidate, id, place, via: what one step makes of each wanted name. inner are
    those that some symbol is called in some scope. id is known only where the step finds a symbol
    itself; place is the order of trial within the step."""
    kind, *args = (step,) if isinstance(step, str) else step
    own = symbols.groupBy(F.col("file").alias("from_file"), "qualified").agg(F.min("id").alias("pos"))
    zero, none, name = F.lit(0).cast("long"), F.lit(None).cast("string"), F.col("name")

    def out(df, candidate, a=zero, b=zero, c=0, text=F.lit(""), via=none, known=F.lit(None).cast("long")):
        place = F.struct(a.alias("a"), b.alias("b"), text.alias("text"), F.lit(c).cast("long").alias("c") if isinstance(c, int) else c.alias("c"))
        return df.select("name", "from_file", candidate.alias("candidate"), known.alias("id"), place.alias("place"), via.alias("via"))

    if kind == "exact":
        return out(wanted, name)
    if kind == "namespace":
        kinds, dotted = args
        space = F.element_at(_ups(F.col("qualified"), sep), -1)
        first = symbols.filter(F.col("qualified").contains(sep)).withColumn("space", space)
        counts = F.col("kind").isin(*kinds)
        counts = counts | F.col("space").contains(sep) if dotted else counts
        first = first.filter(counts).groupBy("qualified", "space").agg(F.min("id").alias("first"))
        first = own.join(first, "qualified").groupBy("from_file").agg(F.min_by("space", F.struct("pos", "first")).alias("scope")).join(scopes, "scope", "left_semi")
        return out(inner.join(first, "from_file"), F.concat("scope", F.lit(sep), name))
    if kind == "parents":
        ups = own.filter(F.col("qualified").contains(sep)).select("from_file", "pos", F.posexplode(F.reverse(_ups(F.col("qualified"), sep))).alias("up", "scope"))
        ups = ups.groupBy("from_file", "scope").agg(F.min(F.struct("pos", "up")).alias("at")).join(scopes, "scope", "left_semi")
        return out(inner.join(ups, "from_file"), F.concat("scope", F.lit(sep), name), F.col("at.pos"), zero, F.col("at.up").cast("long"), via=F.col("scope"))
    every = []
    if kind == "members":
        rules, kinds = args
        for c, rule in enumerate(rules):
            if rule == "scope":
                of_kind = symbols.filter(F.col("kind").isin(*kinds)).groupBy("qualified").agg(F.min("id").alias("first"))
                inside = own.join(of_kind, "qualified").withColumnRenamed("qualified", "scope").join(scopes, "scope", "left_semi")
                every.append(out(inner.join(inside, "from_file"), F.concat("scope", F.lit(sep), name), F.col("pos"), F.col("first"), c))
                continue
            named = symbols.select("qualified", "name", "id")
            if rule == "ends":  # the name, or any end of the qualified name after a separator
                ends = F.array_distinct(F.concat(F.array("name"), _tails(F.col("qualified"), sep)))
                named = named.select("qualified", "id", F.explode(ends).alias("name"))
            named = named.groupBy("qualified", "name").agg(F.min("id").alias("first"))
            found = wanted.join(own.join(named, "qualified"), ["from_file", "name"])
            every.append(out(found, F.col("qualified"), F.col("pos"), F.col("first"), c, known=F.col("first")))
        return reduce(DataFrame.unionByName, every)
    opened = opens.select(F.col("file").alias("from_file"), F.col("module_path").alias("scope"), F.col("ord").cast("long").alias("ord"))
    inside = opened.join(scopes, "scope", "left_semi")
    scope, last = F.col("scope"), F.element_at(F.split("scope", "/"), -1)
    for c, rule in enumerate(args[0]):
        if rule == "suffix":  # an import that names the symbol itself
            ends = opened.select("from_file", "scope", "ord", F.explode(_tails(scope, sep)).alias("name"))
            df, candidate = wanted.join(ends, ["from_file", "name"]), scope
        elif rule == "tail":  # the name begins with the import's last segment
            headed = wanted.filter(name.contains(".")).select("name", "from_file", F.explode(_ups(name, ".")).alias("head"))
            df = headed.join(inside.withColumn("head", last), ["from_file", "head"])
            candidate = F.concat(scope, F.substring(name, F.length(last) + 1, F.length(name)))
        else:
            df, candidate = inner.join(inside, "from_file"), F.concat(scope, F.lit(sep), name)
        every.append(out(df, candidate, F.col("ord"), zero, c, scope, scope))
    return reduce(DataFrame.unionByName, every)


def _tails(text: Column, sep: str) -> Column:
    """What stands after each separator."""
    parts = _parts(text, sep)
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), sep))
    return F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<string>"))


def _known(symbols: DataFrame, language: str) -> DataFrame:
    """candidate, last, file: of overloads the last; in C++ a definition in a source file before one
    in a header, and of those the last."""
    order = F.struct("id")
    if language == "cpp":
        ending = F.lower(F.element_at(F.split("file", r"\."), -1))
        order = F.struct(F.when(ending.isin("cpp", "cc", "c", "cxx"), 2).when(ending.isin("hpp", "h", "hh", "hxx"), 1).otherwise(0), "id")
    return symbols.groupBy(F.col("qualified").alias("candidate")).agg(F.max_by(F.struct("id", "file"), order).alias("s")).select("candidate", F.col("s.id").alias("last"), F.col("s.file").alias("to_file"))


def resolve(wanted: DataFrame, symbols: DataFrame, opens: DataFrame, language: str, order: DataFrame | None = None) -> DataFrame:
    """name, from_file, qualified, symbol_id, resolution, via for each distinct (name, from_file) that
    resolves. order (path, ord), if given, is the compile order that F# respects."""
    sep, steps = RULES[language]
    wanted = wanted.select("name", "from_file").distinct()
    scoped = symbols.filter(F.col("qualified").contains(sep)).select("qualified").distinct()
    scopes = scoped.select(F.explode(_ups(F.col("qualified"), sep)).alias("scope")).distinct()
    called = scoped.select(F.explode(_tails(F.col("qualified"), sep)).alias("name")).distinct()
    inner = wanted.join(called, "name", "left_semi")
    every = []
    for prio, step in enumerate(steps):
        kind = step if isinstance(step, str) else step[0]
        found = _candidates(step, sep, wanted, inner, symbols, opens, scopes)
        every.append(found.withColumns({"prio": F.lit(prio), "resolution": F.lit(NAMES[kind])}))
    found = reduce(DataFrame.unionByName, every).join(_known(symbols, language), "candidate")
    if order is not None and language == "fsharp":
        pairs = found.filter("id is null").select("from_file", "to_file").distinct()
        seen = can_reference(pairs, order).filter("can_reference").select("from_file", "to_file")
        found = found.filter("id is not null").unionByName(found.filter("id is null").join(seen, ["from_file", "to_file"]))
    best = found.groupBy("name", "from_file").agg(F.min_by(F.struct("candidate", F.coalesce("id", "last").alias("id"), "resolution", "via"), F.struct("prio", "place", "candidate")).alias("b"))
    return best.select("name", "from_file", F.col("b.candidate").alias("qualified"), F.col("b.id").alias("symbol_id"), F.col("b.resolution").alias("resolution"), F.col("b.via").alias("via"))


def resolve_dotted(wanted: DataFrame, symbols: DataFrame, opens: DataFrame, language: str, order: DataFrame | None = None) -> DataFrame:
    """name, from_file, qualified: the name as it stands if that is defined; else its first segment
    resolved, with the rest after it; else the name resolved as a whole.

    In Rust dots also count as separators. F# resolves the whole name first, and then takes an import
    that ends in the first segment for it.
    """
    sep = RULES[language][0]
    wanted = wanted.select("name", "from_file").distinct()
    whole = resolve(wanted, symbols, opens, language, order).select("name", "from_file", "qualified", F.lit(3).alias("prio"), F.lit(0).alias("ord"))
    known = _known(symbols, language).select(F.col("candidate").alias("qualified"), "to_file")
    if language in UNDOTTED:
        tried = [whole]
    elif language == "fsharp":
        head, rest = F.substring_index("name", ".", 1), F.expr("substring(name, instr(name, '.'))")
        opened = opens.select(F.col("file").alias("from_file"), "module_path", "ord")
        via = wanted.filter(F.col("name").contains(".")).join(opened, "from_file").filter(F.col("module_path").endswith(head)).withColumn("qualified", F.concat("module_path", rest)).join(known, "qualified")
        if order is not None:
            seen = can_reference(via.select("from_file", "to_file").distinct(), order).filter("can_reference")
            via = via.join(seen.select("from_file", "to_file"), ["from_file", "to_file"], "left_semi")
        tried = [whole, via.select("name", "from_file", "qualified", F.lit(4).alias("prio"), F.col("ord").cast("int"))]
    else:
        path = (lambda c: F.replace(c, F.lit("."), F.lit("::"))) if language == "rust" else (lambda c: c)
        at = F.when(F.col("name").contains("::"), "::").otherwise(".") if language == "rust" else F.lit(sep)
        as_is = [wanted.withColumn("qualified", F.col("name")), *([wanted.withColumn("qualified", path(F.col("name")))] if language == "rust" else [])]
        tried = [df.join(known, "qualified", "left_semi").select("name", "from_file", "qualified", F.lit(p).alias("prio"), F.lit(0).alias("ord")) for p, df in enumerate(as_is)]
        split = wanted.withColumn("sep_", at).filter(F.expr("contains(name, sep_)")).withColumns({"whole": F.col("name"), "name": F.expr("substring(name, 1, instr(name, sep_) - 1)")})
        head = resolve(split, symbols, opens, language).select("name", "from_file", F.col("qualified").alias("head"))
        rest = F.expr("substring(whole, length(name) + length(sep_) + 1)")
        joined = split.join(head, ["name", "from_file"]).select(F.col("whole").alias("name"), "from_file", F.concat("head", F.lit(sep), path(rest)).alias("qualified"))
        tried += [joined.join(known, "qualified", "left_semi").select("name", "from_file", "qualified", F.lit(2).alias("prio"), F.lit(0).alias("ord")), whole]
    return reduce(DataFrame.unionByName, tried).groupBy("name", "from_file").agg(F.min_by("qualified", F.struct("prio", "ord", "qualified")).alias("qualified"))

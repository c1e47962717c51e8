"""Dependency graphs: what refs resolve to, and breadth-first walks over it in both directions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, shuffled
from .lookup import can_reference
from .refs import containing_symbol, references_any, split_keys, suffixes, target_keys, with_keys
from .search import cascade, search, suggest_similar


def _visible(candidates: DataFrame, order: DataFrame | None) -> DataFrame:
    """candidates (from_file, to_file, ...) that the compile order allows."""
    if order is None:
        return candidates
    pairs = can_reference(candidates.select("from_file", "to_file").distinct(), order).filter("can_reference")
    return candidates.join(pairs.drop("can_reference"), ["from_file", "to_file"])


def _grams(text):
    """Distinct substrings of one to three characters: what a contained string of any length shares."""
    n = F.char_length(text)

    def of(k: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _by_rarest_gram(names: DataFrame, indexed: DataFrame) -> DataFrame:
    """query, gram: each query with its gram that the fewest symbols hold; none if some gram is in no
    symbol, as then nothing contains the query."""
    low, n = F.lower("query"), F.char_length("query")
    width = F.least(n, F.lit(3))
    grams = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(low, i, width))
    own = materialise(names.filter(n > 0).select("query", F.explode(F.array_distinct(grams)).alias("gram")))
    held = indexed.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
    best = own.join(held, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct("held", "gram")).alias("gram"), F.count_if(F.isnull("held")).alias("absent"))
    return best.filter("absent = 0").select("query", "gram")


def resolve_refs(symbols: DataFrame, opens: DataFrame, refs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """file, name, target for each distinct ref of a file: the symbol that it means, null for none.

    First the name itself, then each import of the file joined to it by a dot, in order (only names
    that some symbol ends in meet imports), then the first hit of the ranked search. The last is a search for a substring; it runs only for distinct
    names that the first two leave, as an equality join on the name's rarest gram with the rule as a
    residual.
    """
    wanted = shuffled(materialise(refs.select(F.col("file").alias("from_file"), "name").distinct()))
    last = shuffled(symbols.groupBy("qualified").agg(F.max_by("file", "id").alias("to_file")))
    exact = _visible(wanted.join(last, F.col("name") == F.col("qualified")), order)
    exact = exact.select("from_file", "name", F.lit(1).alias("prio"), F.lit(0).alias("ord"), F.col("qualified").alias("target"))
    opened = opens.select(F.col("file").alias("from_file"), "module_path", "ord")
    ends = shuffled(symbols.select(F.explode(suffixes(F.col("qualified"))).alias("name")).distinct())
    joined = wanted.join(ends, "name", "left_semi").join(opened, "from_file").withColumn("qualified", F.concat_ws(".", "module_path", "name")).join(last, "qualified")
    joined = _visible(joined, order).select("from_file", "name", F.lit(2).alias("prio"), "ord", F.col("qualified").alias("target"))
    found = shuffled(materialise(exact.unionByName(joined).groupBy("from_file", "name").agg(F.min_by("target", F.struct("prio", "ord", "target")).alias("target"))))
    left = shuffled(materialise(wanted.join(found, ["from_file", "name"], "left_anti")))
    low = F.lower("query")
    text = F.lower(F.concat_ws("\n", "name", "qualified"))
    kinds = symbols.select("name", "qualified", *([] if order is None else [F.col("file").alias("to_file")])).distinct()
    indexed = kinds.select("*", F.explode(_grams(text)).alias("gram"))
    names = _by_rarest_gram(left.select(F.col("name").alias("query")).distinct(), indexed)
    hit = F.lower("name").startswith(low) | F.lower("qualified").contains(low)
    best = F.struct(F.lower("name") != low, ~F.lower("name").startswith(low), F.octet_length("name"), "qualified")
    hits = names.join(indexed, "gram").filter(hit).withColumn("best", best)
    if order is None:
        chosen = hits.groupBy(F.col("query").alias("name")).agg(F.min_by("qualified", "best").alias("target"))
        searched = left.join(chosen, "name")
    else:
        near = _visible(left.join(hits.withColumnRenamed("name", "hit_name"), F.col("name") == F.col("query")), order)
        searched = near.groupBy("from_file", "name").agg(F.min_by("qualified", "best").alias("target"))
    known = shuffled(found.unionByName(searched.select("from_file", "name", "target")))
    return wanted.join(known, ["from_file", "name"], "left").select(F.col("from_file").alias("file"), "name", "target")


def _walk(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], max_depth: int) -> DataFrame:
    """root, qualified, depth: all that step() reaches from the seeds, at its least depth.

    Each level is one join and one anti-join; levels are written to the shared folder, and the walk
    ends at an empty one."""
    level = materialise(seeds.select("root", "qualified").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        reached = step(level).select("root", "qualified").distinct()
        level = materialise(reached.join(shuffled(seen), ["root", "qualified"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def _forward(symbols: DataFrame, refs: DataFrame, opens: DataFrame, order: DataFrame | None):
    """The step of a forward walk: all refs of the files that define the level's nodes, resolved. Only
    files that the walk comes to are ever resolved, each once for a root; the names that files refer
    to are taken from the refs once."""
    last = shuffled(symbols.groupBy("qualified").agg(F.max_by("file", "id").alias("file")))
    done: list[DataFrame] = []
    names: list[DataFrame] = []

    def step(level: DataFrame) -> DataFrame:
        if not names:
            names.append(materialise(refs.select("file", "name").distinct()))
        files = shuffled(level).join(last, "qualified").select("root", "file").distinct()
        for before in done:
            files = files.join(shuffled(before), ["root", "file"], "left_anti")
        files = materialise(files)
        done.append(files)
        own = names[0].join(files.select("file").distinct(), "file", "left_semi")
        edges = resolve_refs(symbols, opens, own, order).filter("target is not null")
        return shuffled(files).join(shuffled(edges), "file").select("root", F.col("target").alias("qualified"))

    return step


def spider(symbols: DataFrame, refs: DataFrame, opens: DataFrame, entry: str, max_depth: int, order: DataFrame | None = None) -> DataFrame:
    """qualified, depth: what the entry depends on. A node's dependencies are all refs of the file
    that defines it (of overloads, the last one). Nothing if the entry is not defined."""
    seeds = symbols.filter(F.col("qualified") == entry).select(F.lit(0).alias("root"), "qualified")
    return _walk(seeds, _forward(symbols, refs, opens, order), max_depth).select("qualified", "depth")


def spider_unresolved(symbols: DataFrame, refs: DataFrame, opens: DataFrame, entry: str, max_depth: int, order: DataFrame | None = None) -> DataFrame:
    """name: the refs that resolve to nothing, of all nodes that the walk goes on from."""
    seeds = symbols.filter(F.col("qualified") == entry).select(F.lit(0).alias("root"), "qualified")
    nodes = _walk(seeds, _forward(symbols, refs, opens, order), max_depth).filter(F.col("depth") < max_depth)
    last = symbols.groupBy("qualified").agg(F.max_by("file", "id").alias("file"))
    files = nodes.join(last, "qualified").select("file").distinct()
    edges = resolve_refs(symbols, opens, refs.join(files, "file", "left_semi"), order)
    return edges.filter("target is null").select("name").distinct()


def _targets(symbols: DataFrame, qualified: DataFrame) -> DataFrame:
    """target, short for each distinct qualified name that is defined; short is its first overload's."""
    first = symbols.groupBy("qualified").agg(F.min_by("name", "id").alias("short"))
    return qualified.select("qualified").distinct().join(first, "qualified").select(F.col("qualified").alias("target"), "short")


def reverse_spider(symbols: DataFrame, refs: DataFrame, entry: str, max_depth: int) -> DataFrame:
    """qualified, depth: what depends on the entry, by the symbols that hold the refs to it.

    A level needs to know which symbols refer to any of it, not to which: one semi-join on keys.
    """
    if max_depth <= 1:
        held = containing_symbol(symbols, references_any(_targets(symbols, symbols.filter(F.col("qualified") == entry)), refs))
    else:
        held = containing_symbol(symbols, refs)
    held = materialise(with_keys(held.filter("container is not null").select("name", "container").distinct()))

    def step(level: DataFrame) -> DataFrame:
        keys = target_keys(_targets(symbols, level)).select("key_")
        return held.join(keys, "key_", "left_semi").select(F.lit(0).alias("root"), F.col("container").alias("qualified"))

    seeds = symbols.filter(F.col("qualified") == entry).select(F.lit(0).alias("root"), "qualified")
    return _walk(seeds, step, max_depth).select("qualified", "depth")


def callers(symbols: DataFrame, refs: DataFrame, entry: str) -> DataFrame:
    """The symbols that refer to the entry directly, itself not counted."""
    return reverse_spider(symbols, refs, entry, 1).filter("depth = 1").select("qualified")


def find_callers(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """asked, qualified, how: the callers of a symbol as a user asks for them. An unknown name stands
    for the first symbol that the pattern search finds (how: searched); if there is none either, the
    rows are near names with how suggested."""
    exact = symbols.filter(F.col("qualified") == name).orderBy("id").limit(1).select("qualified", F.lit("exact").alias("how"))
    found = search(symbols, name, 1).select("qualified", F.lit("searched").alias("how"))
    taken = cascade(exact, found).drop("branch").first()
    if taken is None:
        return suggest_similar(symbols, name).select(F.lit(name).alias("asked"), F.col("value").alias("qualified"), F.lit("suggested").alias("how"))
    return callers(symbols, refs, taken["qualified"]).select(F.lit(taken["qualified"]).alias("asked"), "qualified", F.lit(taken["how"]).alias("how"))


def spider_from_file(symbols: DataFrame, refs: DataFrame, opens: DataFrame, file: str, max_depth: int) -> DataFrame:
    """qualified, depth: the walks from each symbol of a file in turn; of what several reach, the
    first walk's depth, which need not be the least.

    Symbols whose definitions lie in one file start from the same refs, so their walks differ in the
    symbol itself alone: the first of them is walked for all."""
    own = symbols.filter(F.col("file") == file).groupBy("qualified").agg(F.min("id").alias("root"))
    last = shuffled(symbols.groupBy("qualified").agg(F.max_by("file", "id").alias("home")))
    seeds = own.join(last, "qualified").groupBy("home").agg(F.min_by(F.struct("root", "qualified"), "root").alias("s")).select("s.*")
    found = _walk(seeds, _forward(symbols, refs, opens, None), max_depth)
    found = found.unionByName(own.withColumn("depth", F.lit(0)))
    return found.groupBy("qualified").agg(F.min_by("depth", F.struct("root", "depth")).alias("depth"))


def with_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """nodes with the name, kind, file and line of each (of overloads, the last one)."""
    last = symbols.groupBy("qualified").agg(F.max_by(F.struct("name", "kind", "file", "line"), "id").alias("s")).select("qualified", "s.*")
    return nodes.join(last, "qualified", "left")


def files_touched(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    return with_symbols(nodes, symbols).select("file").distinct()


def formatted(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """depth, line_text: each node's line, two spaces further in a level."""
    full = with_symbols(nodes, symbols)
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), "qualified", F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    return full.select("depth", "qualified", text.alias("line_text"))


def enrich(symbols: DataFrame, refs: DataFrame, opens: DataFrame, entry: str) -> DataFrame:
    """One row: the symbol with the sorted names of its callers and of what it depends on."""
    refs = materialise(refs.select("name", "file", "line")).withColumn("id", F.lit(0).cast("long"))
    own = symbols.filter(F.col("qualified") == entry).orderBy("id").limit(1).select("qualified", "kind", "file", "line")
    called = callers(symbols, refs, entry).agg(F.sort_array(F.collect_set("qualified")).alias("callers"))
    needs = spider(symbols, refs, opens, entry, 1).filter("depth = 1").agg(F.sort_array(F.collect_set("qualified")).alias("dependencies"))
    parts = [own.select(F.struct("*").alias("own_")), called, needs]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    one = every.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("own_", "callers", "dependencies")])
    return one.filter("own_ is not null").select("own_.*", "callers", "dependencies")


def _caller_counts(symbols: DataFrame, refs: DataFrame, targets: DataFrame) -> DataFrame:
    """target, callers: how many symbols other than itself hold refs to each target (target, short).

    Who refers to a short name is counted once for all targets that have it, not once for each; what
    a target has besides comes on top, and it takes itself off.
    """
    sites = materialise(refs.select("name", "file", "line"))
    names = with_keys(sites.select("name").distinct()).join(split_keys(targets), "key_").select("name", "short", "target").distinct()
    wanted = sites.join(names.select("name").distinct(), "name", "left_semi")
    lines = wanted.select("file", "line", F.lit(0).cast("long").alias("id")).distinct()
    holders = containing_symbol(symbols, lines).filter("container is not null").select("file", "line", "container")
    held = wanted.join(holders.hint("shuffle_hash"), ["file", "line"])
    pairs = materialise(held.join(names, "name").select("short", "target", "container").distinct())
    near = pairs.filter("target is null").select("short", "container")
    far = pairs.filter("target is not null").join(shuffled(near), ["short", "container"], "left_anti")
    alike = shuffled(near.groupBy("short").agg(F.count("*").alias("alike_")))
    more = shuffled(far.filter("container <> target").groupBy("target").agg(F.count("*").alias("more_")))
    own = shuffled(near.select("short", F.col("container").alias("target"), F.lit(1).alias("own_")))
    counted = shuffled(targets).join(alike, "short", "left").join(more, "target", "left").join(own, ["short", "target"], "left")
    return counted.select("target", F.expr("coalesce(alike_, 0) + coalesce(more_, 0) - coalesce(own_, 0)").alias("callers"))


def analyse_frames(frames: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """frames (with symbol) with the file and line of the symbol's definition and how many symbols
    call it; by qualified name, else by the first symbol of that name."""
    exact = symbols.groupBy(F.col("qualified").alias("symbol")).agg(F.min_by(F.struct("qualified", "file", "line"), "id").alias("by_qualified"))
    named = symbols.groupBy(F.col("name").alias("symbol")).agg(F.min_by(F.struct("qualified", "file", "line"), "id").alias("by_name"))
    placed = frames.join(shuffled(exact), "symbol", "left").join(shuffled(named), "symbol", "left").withColumn("s_", F.coalesce("by_qualified", "by_name")).drop("by_qualified", "by_name")
    targets = _targets(symbols, placed.select(F.col("s_.qualified").alias("qualified")).filter("qualified is not null"))
    counts = _caller_counts(symbols, refs, targets)
    joined = placed.join(shuffled(counts), F.col("s_.qualified") == F.col("target"), "left")
    return joined.select(*frames.columns, F.col("s_.qualified").alias("defined_as"), F.col("s_.file").alias("defined_in"), F.col("s_.line").alias("defined_at"), F.coalesce("callers", F.lit(0)).alias("callers"))


def rename_plan(symbols: DataFrame, refs: DataFrame, qualified: str, new_name: str) -> DataFrame:
    """file, line, column, new_text: the edits that rename a symbol; a ref keeps what stands before
    its last segment."""
    from .refs import find_references_defined

    own = symbols.filter(F.col("qualified") == qualified).select("file", "line", "column", F.lit(new_name).alias("new_text"))
    text = F.concat(F.regexp_extract("name", r"^(.*\.)?[^.]*$", 1), F.lit(new_name))
    others = find_references_defined(symbols, refs, qualified).select("file", "line", "column", text.alias("new_text"))
    return own.unionByName(others).distinct()


def missing_opens(symbols: DataFrame, opens: DataFrame, refs: DataFrame, file: str) -> DataFrame:
    """module: what a file would have to import so that its unresolved refs have a definition."""
    own = refs.filter(F.col("file") == file)
    edges = resolve_refs(symbols, opens.filter(F.col("file") == file), own)
    known = symbols.select(F.col("qualified").alias("name")).distinct()
    open_here = opens.filter(F.col("file") == file).select(F.col("module_path").alias("module"))
    names = own.select("name").distinct().join(known, "name", "left_anti")
    reached = edges.filter("target is not null").select("name", "target")
    module = F.regexp_extract("target", r"^(.*)\.[^.]*$", 1)
    return names.join(reached, "name").select(module.alias("module")).filter("module <> ''").distinct().join(open_here, "module", "left_anti")



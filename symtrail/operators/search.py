"""Search: patterns, full text, edit distance, and the ranked in-memory form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import glob_to_like, like

#: How far names may be by default, and how many are suggested.
MAX_DISTANCE, SUGGESTIONS = 3, 5


def matching(symbols: DataFrame, pattern: str, language: str | None = None) -> DataFrame:
    wanted = glob_to_like(pattern)
    found = symbols.filter(like(F.col("name"), wanted) | like(F.col("qualified"), wanted))
    return found if language is None else found.filter(F.col("language") == language)


def search(symbols: DataFrame, pattern: str, limit: int | None, language: str | None = None) -> DataFrame:
    """Names or qualified names that match a glob, in the order in which they were added."""
    found = matching(symbols, pattern, language).orderBy("id")
    return found if limit is None else found.limit(limit)


def tokens(text: Column) -> Column:
    """Distinct words of letters, digits and underscores, lower-cased, without diacritics that have
    a letter of their own in Latin."""
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.filter(F.split(F.translate(F.lower(text), marked, plain), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def search_words(symbols: DataFrame, query: str, limit: int | None, language: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Symbols whose names hold every term of the query, best first by BM25 over (name, qualified).

    A term that ends in `*` is a prefix; text in double quotes is a phrase. Ranks are positive,
    larger is better; ties go by id. Without a limit, all of them.
    """
    phrases = [p.split() for p in query.split('"')[1::2]]
    terms = [w.lower() for part in query.split('"')[::2] for w in part.split()]
    words = symbols.select("id", "language", F.concat(tokens(F.col("name")), tokens(F.col("qualified"))).alias("words"))
    size = F.size("words")

    def hits(term: str) -> Column:
        if term.endswith("*"):
            return F.size(F.filter("words", lambda w: w.startswith(term[:-1])))
        return F.size(F.filter("words", lambda w: w == term))

    def phrase_hits(phrase: list[str]) -> Column:
        places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
        wanted = F.array(*[F.lit(w.lower()) for w in phrase])
        return F.size(F.filter(places, lambda i: F.slice("words", i, len(phrase)) == wanted))

    counts = [hits(t) for t in terms] + [phrase_hits(p) for p in phrases if p]
    if not counts:
        return symbols.limit(0).withColumn("rank", F.lit(0.0))
    counted = words.withColumns({f"c{i}": c for i, c in enumerate(counts)} | {"size": size})
    stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"df{i}") for i in range(len(counts))])
    every = F.lit(True)
    score = F.lit(0.0)
    for i in range(len(counts)):
        tf = F.col(f"c{i}")
        every = every & (tf > 0)
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.greatest(idf, F.lit(1e-6)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    found = counted.filter(every) if language is None else counted.filter(every & (F.col("language") == language))
    ranked = found.join(F.broadcast(stats), F.lit(True)).select("id", score.alias("rank"))
    best = symbols.join(ranked, "id").orderBy(F.desc("rank"), "id")
    return best if limit is None else best.limit(limit)


def search_text(symbols: DataFrame, pattern: str, limit: int | None, language: str | None = None) -> DataFrame:
    """Full text: a word means a prefix, `word*` too; a star elsewhere falls back to the pattern."""
    if "*" in pattern[:-1]:
        return search(symbols, pattern, limit, language)
    return search_words(symbols, pattern if pattern.endswith("*") else pattern + "*", limit, language).drop("rank")


def nearness(c: Column, query: str, max_distance: int) -> Column:
    """Edit distance over characters; -1 beyond max_distance. Lengths too far apart cost nothing."""
    close = F.abs(F.char_length(c) - len(query)) <= max_distance
    return F.when(close, F.levenshtein(c, F.lit(query), max_distance)).otherwise(F.lit(-1))


def fuzzy_search(symbols: DataFrame, query: str, max_distance: int, limit: int, language: str | None = None) -> DataFrame:
    """Symbols whose name or qualified name is within max_distance, nearest first. Exact: all symbols
    are candidates, none is left out by a prefix."""
    far = F.lit(1 << 20)
    both = [F.when(nearness(F.col(c), query, max_distance) >= 0, nearness(F.col(c), query, max_distance)).otherwise(far) for c in ("name", "qualified")]
    found = symbols.withColumn("distance", F.least(*both)).filter(F.col("distance") <= max_distance)
    found = found if language is None else found.filter(F.col("language") == language)
    return found.orderBy("distance", "id").limit(limit)


def all_names(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("name").alias("value")).union(symbols.select("qualified")).distinct()


def suggest_similar(symbols: DataFrame, query: str, max_distance: int = MAX_DISTANCE, limit: int = SUGGESTIONS) -> DataFrame:
    """value, distance: the nearest names that differ from the query."""
    return find_similar(all_names(symbols), query, max_distance, limit)


def find_similar(values: DataFrame, query: str, max_distance: int = MAX_DISTANCE, limit: int = SUGGESTIONS) -> DataFrame:
    near = values.withColumn("distance", nearness(F.col("value"), query, max_distance))
    return near.filter("distance > 0").orderBy("distance", "value").limit(limit)


def search_ranked(symbols: DataFrame, query: str) -> DataFrame:
    """In-memory search, without regard to case: with `*` by name only, at its start, end or middle as
    the stars say; without, name prefixes and qualified names that contain it. Exact names first,
    then prefixes, then shorter names in bytes."""
    low, name = query.lower(), F.lower("name")
    bare = low.replace("*", "")
    if "*" in low:
        if low.startswith("*") and low.endswith("*"):
            hit = name.contains(bare)
        elif low.startswith("*"):
            hit = name.endswith(bare)
        elif low.endswith("*"):
            hit = name.startswith(bare)
        else:
            hit = name.contains(bare)
    else:
        hit = name.startswith(low) | F.lower("qualified").contains(low)
    order = [F.desc(name == bare), F.desc(name.startswith(bare)), F.octet_length("name"), F.col("qualified"), F.col("id")]
    return symbols.filter(hit).orderBy(*order)


def search_projects(symbols: DataFrame, pattern: str, limit: int, project: str = "project") -> DataFrame:
    """search() within each project."""
    w = Window.partitionBy(project).orderBy("id")
    return matching(symbols, pattern).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def fuzzy_search_projects(symbols: DataFrame, query: str, limit: int, max_distance: int = MAX_DISTANCE, project: str = "project") -> DataFrame:
    far = F.lit(1 << 20)
    both = [F.when(nearness(F.col(c), query, max_distance) >= 0, nearness(F.col(c), query, max_distance)).otherwise(far) for c in ("name", "qualified")]
    found = symbols.withColumn("distance", F.least(*both)).filter(F.col("distance") <= max_distance)
    w = Window.partitionBy(project).orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def find_symbols(symbols: DataFrame, pattern: str, limit: int, language: str | None = None, fuzzy: bool = False, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The symbols that a user lists: by pattern, or, asked for it, by what is spelt alike."""
    found = fuzzy_search(symbols, pattern, max_distance, limit, language) if fuzzy else search(symbols, pattern, limit, language).withColumn("distance", F.lit(None).cast("int"))
    return found


def location_text(symbols: DataFrame) -> DataFrame:
    """id, location: file, line and column, as editors and compilers write them."""
    return symbols.select("id", F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string")).alias("location"))


def tool_search(symbols: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """search(), exact names first, then shorter ones."""
    found = search(symbols, pattern, limit)
    exact = (F.col("name") == pattern).cast("int")
    return found.orderBy(F.desc(exact), F.octet_length("name"), "id")


def cascade(*branches: DataFrame) -> DataFrame:
    """The first branch that has rows, in one plan. All have the same columns; each is short."""
    every = None
    for i, b in enumerate(branches):
        own = b.withColumn("branch", F.lit(i))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    first = every.agg(F.min("branch").alias("branch"))
    return every.join(F.broadcast(first), "branch")


def definition(symbols: DataFrame, name: str) -> DataFrame:
    """branch 0: the definition itself; 1: the first match of the pattern; 2: what is spelt alike.
    qualified is the answer's name in each."""
    exact = symbols.filter(F.col("qualified") == name).orderBy("id").limit(1).select("qualified", "file", "line")
    match = search(symbols, name, 10).orderBy("id").limit(1).select("qualified", "file", "line")
    alike = suggest_similar(symbols, name).select(F.col("value").alias("qualified"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    return cascade(exact, match, alike)


def tool_definition(symbols: DataFrame, name: str) -> DataFrame:
    """The exact definition with confidence 1.0, else up to five near names with 0.5."""
    exact = symbols.filter(F.col("qualified") == name).orderBy("id").limit(1)
    columns = ["qualified", "file", "line"]
    sure = exact.select(*columns, F.lit(1.0).alias("confidence"), F.lit("exact").alias("match"))
    near = fuzzy_search(symbols, name, MAX_DISTANCE, 5).select(*columns, F.lit(0.5).alias("confidence"), F.lit("fuzzy").alias("match"))
    return cascade(sure, near).drop("branch")



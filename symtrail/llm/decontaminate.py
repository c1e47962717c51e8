"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a mask over neighbouring words that ignores some of them, so a seed survives a replaced
word that it does not look at. The masks leave out a residue modulo five, so words replaced one in
five still leave seeds whole. Seeds that a document shares with a benchmark item put the two side by
side on a diagonal, and around each hit the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, whole_text

WORD = r"[\p{L}\p{N}]+"
#: Places that a seed looks at. In a window of 20 words with 4 replaced some seed is whole wherever
#: they are. Items shorter than a window have fewer places: SHORT_MASK makes sure of those of eight
#: words or more, and still shorter ones have masks that leave out each word in turn.
MASKS = ((0, 1, 3, 4, 6), (0, 1, 2, 4, 7), (0, 2, 3, 5, 7))
SHORT_MASK = (0, 1, 5, 6)
#: Words of a compared window, the share of them that must agree, and the fewest words of an item.
WINDOW, SIMILARITY, LEAST = 20, 0.8, 5
#: Benchmarks of at most this many words are broadcast; larger ones are joined by a shuffle.
BROADCAST_WORDS = 1_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(whole_text(text)), F.lit(WORD), F.lit(0))


def _masks(sizes: list[int], masks, window: int) -> list[tuple[tuple[int, ...], int, int]]:
    """The masks that items of these sizes (all below the window) need beside `masks`, and the sizes
    of the items that each is for."""
    widest = max(m[-1] for m in masks) + 1
    every = [(tuple(m), widest, 1 << 30) for m in masks]
    if any(widest <= n < window for n in sizes):
        every.append((SHORT_MASK, widest, window - 1))
    for n in sorted(n for n in sizes if n < widest):
        every += [(tuple(i for i in range(n) if i != gap), n, n) for gap in range(n)]
    return every


def _seeds(words: Column, at: Column, masks, size: Column | None = None) -> Column:
    """The seed's hash for each mask whose words are all there, and that is for items of this size."""
    every = []
    for m, (mask, least, most) in enumerate(masks):
        there = F.get(words, at + mask[-1]).isNotNull()
        there = there if size is None else there & size.between(least, most)
        every.append(F.when(there, F.xxhash64(F.lit(m), *[F.get(words, at + i) for i in mask])))
    return F.array(*every)


def _equal_words(words: Column, item: Column, at: Column, place: Column, window: int) -> Column:
    """1 or 0 for each of the item's places in the windows that hold `place`, laid over the words so
    that it meets `at`. Windows lie within the item; words beyond the document differ."""
    size = F.least(F.size(item), F.lit(window))
    first, last = F.greatest(place - size + 1, F.lit(0)), F.least(place + size, F.size(item))
    shift = at - place
    return F.transform(F.sequence(first, last - 1), lambda i: F.coalesce((F.get(words, shift + i) == F.get(item, i)).cast("int"), F.lit(0)))


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, n_words, matched, window, first_word: the leaks, one row for each document
    and item.

    An item leaks into a document if a window of `window` of its words (the whole item if it is
    shorter) agrees with the document in at least `similarity` of the places, some seed within the
    window agreeing as well. Words are runs of letters and digits, lower-cased. matched is the
    best agreement, first_word the first place in the document that such a window lies over. Items
    of fewer than LEAST words leak nowhere, being no evidence. Null and empty texts have no leaks. Rows that repeat a doc_id give one row an item;
    a null doc_id gives rows with a null doc_id. Columns other than those named are ignored.

    The benchmark is broadcast if it has at most broadcast_words words, which is counted first;
    else seeds are joined by a shuffle and the candidates' texts once more.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("item_")).filter(F.size("item_") >= LEAST)
    items = items.withColumn("item_key_", F.xxhash64("item_id", "item_"))
    # at most `window` rows of one number each
    short = [r[0] for r in items.filter(F.size("item_") < window).select(F.size("item_")).distinct().collect()]
    total = items.agg(F.sum(F.size("item_"))).first()[0] or 0
    small = total <= broadcast_words
    every = _masks(short, masks, window)
    places = items.select("item_key_", "item_", F.posexplode("item_").alias("place_", "w_"))
    seeds = places.select("item_key_", "place_", F.explode(F.array_compact(_seeds(F.col("item_"), F.col("place_"), every, F.size("item_")))).alias("seed_")).dropDuplicates(["item_key_", "place_", "seed_"])
    listed = items.select("item_key_", "item_id", "item_").dropDuplicates(["item_key_"])
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tag_"), _words(F.col("text")).alias("words_"))
    rows = rows.withColumn("n_words", F.size("words_"))
    at = F.col("at_")
    placed = rows.select("doc_id", "tag_", "words_", "n_words", F.explode(F.when(F.col("n_words") >= LEAST, F.sequence(F.lit(0), F.col("n_words") - LEAST))).alias("at_"))
    seeded = placed.select("doc_id", "tag_", "words_", "n_words", "at_", F.explode(_seeds(F.col("words_"), at, every)).alias("seed_"))
    if small:
        hits = seeded.join(F.broadcast(seeds), "seed_").join(F.broadcast(listed), "item_key_")
    else:
        found = seeded.select("doc_id", "tag_", "at_", "seed_").filter("seed_ is not null").join(seeds, "seed_")
        found = found.select("doc_id", "tag_", "at_", "item_key_", "place_").distinct().join(listed, "item_key_").withColumnsRenamed({"doc_id": "doc_", "tag_": "doc_tag_"})
        hits = rows.dropDuplicates(["doc_id", "tag_"]).join(found, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("tag_") == F.col("doc_tag_")))
    same = _equal_words(F.col("words_"), F.col("item_"), at, F.col("place_"), window)
    checked = hits.select("doc_id", "item_id", "n_words", at, "place_", F.size("item_").alias("size_"), same.alias("same_"))
    size = F.least(F.col("size_"), F.lit(window))
    span = F.least(F.col("place_") + size, F.col("size_")) - F.greatest(F.col("place_") - size + 1, F.lit(0))
    need = F.ceil(size * similarity - 1e-9)
    sums = F.transform(F.sequence(F.lit(1), span - size + 1), lambda s: F.aggregate(F.slice("same_", s, size), F.lit(0), lambda a, x: a + x))
    enough = F.aggregate("same_", F.lit(0), lambda a, x: a + x) >= need  # in all; most chance hits end here
    verified = checked.filter(enough).withColumn("sums_", sums).withColumn("matched", F.array_max("sums_")).filter(F.col("matched") >= need)
    start = at - F.col("place_") + F.greatest(F.col("place_") - size + 1, F.lit(0)) + F.array_position("sums_", F.col("matched")).cast("int") - 1
    out = verified.select("doc_id", "item_id", F.col("n_words").cast("long"), "matched", size.alias("window"), F.greatest(start, F.lit(0)).alias("first_word"))
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("matched").alias("matched"), F.max("window").alias("window"), F.min("first_word").alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs, with all their columns, without the documents that an item leaks into."""
    leaked = leaks(docs, benchmark, **parameters).select(F.col("doc_id").alias("leaked_id_")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id_"]), "left_anti")


def op5_benchmark_decontamination(spark, sf_dir):
    """Every leak of an item of benchmark into a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Personal data and secrets: keyed, type-consistent surrogates, in DataFrame functions only.

One pattern finds the entities. An entity's surrogate depends on a key, its type and its normal form
alone, so it is the same wherever the entity stands. It keeps the format: digits stay digits, letters
stay letters of their script and case, separators and public prefixes stay, a card number that passes
the Luhn check has a surrogate that does, and names keep gender and script. Surrogates of different
entities are compared over the whole corpus; where two agree, or one is itself a real entity, the
later entity gets its next surrogate, until all are distinct. Names, secrets and e-mail addresses, of
which short ones have few surrogates, get longer ones every few draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, table, whole_text

#: The setting of the session that holds the key, and the key where it is unset, as in tests.
KEY_SETTING, KEY = "spark.symtrail.surrogate.key", "surrogates"
#: Rounds in which surrogates that collide are drawn anew; each leaves a tiny share of the last.
ROUNDS = 20
#: After so many draws of an entity its surrogate gets one more letter or syllable.
DRAWS_A_LENGTH = 3

_A, _Z = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# a word of two letters or more, without the 's of a possessive
_NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!(?<=['’])[sS](?!\p{L})))+"
_INITIAL = r"\p{Lu}\.(?:-?\p{Lu}\.)*"
# Forms of address by the gender that they tell.
MALE = ("Mr", "Mister", "Sir", "Señor", "Sr", "Don", "Herr", "Monsieur", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Señora", "Sra", "Doña", "Frau", "Madame", "Mme", "Mademoiselle", "Г-жа")
OTHER = ("Dr", "Prof", "Professor", "Doctor")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *OTHER), key=len, reverse=True))
# Small words within surnames.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "des", "la", "le", "las", "los", "ter", "ten", "te", "zu", "zum", "zur", "af", "av", "bin", "bint", "ibn", "ben", "abu", "al", "el", "y", "e", "d'", "d’")
_TITLE = rf"(?:(?:{_TITLES})\.? )+"
_PARTICLES = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )*"
# a single letter without a stop is an initial right after a title, or before one more name word
_FIRST = rf"(?:{_NAME}|{_INITIAL}|(?!I)\p{{Lu}}(?![\p{{L}}\p{{N}}'’]))"
_NEXT = rf"(?:(?!(?:{_TITLES})(?!\p{{L}})){_NAME}|{_INITIAL}|\p{{Lu}}(?= \p{{Lu}}\p{{L}}))"
#: What a further mention of a name word may be.
_MENTION = rf"{_A}{_NAME}{_Z}"

#: Types in the order in which they are tried, and their patterns.
PATTERNS = {
    "email": rf"[\p{{L}}\p{{N}}._%+-]+@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,}}",
    "secret": rf"(?i:{_A}(?:password|passwd|pwd|token|secret|api[_-]?key))\s*[=:]\s*[\"']?[A-Za-z0-9_+/=-]{{8,}}[\"']?",
    "access_key": rf"{_A}(?:AKIA|ASIA)[0-9A-Z]{{16}}{_Z}",
    "iban": rf"{_A}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_Z}",
    "phone": rf"(?:{_A}\+\d{{1,3}}|(?<![\p{{L}}\p{{N}}+])\+\d{{1,3}})[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{1,4}}{_Z}|\(\d{{3}}\) ?\d{{3}}-\d{{4}}{_Z}|{_A}\d{{3}}-\d{{3}}-\d{{4}}{_Z}",
    "ssn": rf"{_A}\d{{3}}-\d{{2}}-\d{{4}}{_Z}",
    "card": rf"{_A}\d(?:[ -]?\d){{12,18}}{_Z}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "name": rf"{_A}{_TITLE}{_PARTICLES}{_FIRST}(?: {_PARTICLES}{_NEXT})*",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Letters that may take each other's place: one script and case each.
POOLS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåçèéêëìíîïñòóôõöùúûüý",
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
)


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the whole entity matches."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(rf"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def _number(seed: Column, at: Column, below: int) -> Column:
    """A number below `below`, drawn by the seed's text for place `at`."""
    return F.pmod(F.xxhash64(seed, at), F.lit(below)).cast("int")


def _scrambled(text: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """Each digit by a digit and each letter by one of its script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pool in POOLS:
            out = F.when(F.lit(pool).contains(c), F.substring(F.lit(pool), 1 + _number(seed, i, len(pool)), F.lit(1))).otherwise(out)
        if hexadecimal is not None:
            out = F.when(hexadecimal & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), 1 + _number(seed, i, 6), F.lit(1))).otherwise(out)
        return F.when(c.rlike("[0-9]"), _number(seed, i, 10).cast("string")).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits modulo ten."""

    def part(c: Column, i: Column) -> Column:
        twice = F.pmod(F.char_length(digits) - i, F.lit(2)) == 0
        d = c.cast("int") * F.when(twice, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(text: Column, seed: Column) -> Column:
    drawn = F.concat(F.substring(text, 1, 1), _scrambled(F.expr("substring(entity_, 2)"), seed))
    bare = F.regexp_replace(drawn, "[^0-9]", "")
    valid = _luhn(F.regexp_replace(text, "[^0-9]", "")) == 0
    last = F.pmod(F.right(drawn, F.lit(1)).cast("int") + 10 - _luhn(bare), F.lit(10))  # the last digit counts once
    return F.when(valid, F.concat(F.left(drawn, F.char_length(drawn) - 1), last.cast("string"))).otherwise(drawn)


def _iban_rest(text: Column) -> Column:
    """What an account number leaves modulo 97, its first four characters taken last; letters count
    from ten on."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.left(bare, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(text: Column, seed: Column) -> Column:
    """The country stays; where the check digits were right, they are right again."""
    drawn = F.concat(F.left(text, F.lit(2)), _scrambled(F.expr("substring(entity_, 3)"), seed))
    rest = F.substring(drawn, F.lit(5), F.char_length(drawn))
    check = 98 - _iban_rest(F.concat(F.left(text, F.lit(2)), F.lit("00"), rest))
    checked = F.concat(F.left(text, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), rest)
    return F.when(_iban_rest(text) == 1, checked).otherwise(drawn)


def _is_initial(word: Column) -> Column:
    return word.rlike(rf"^(?:{_INITIAL}|\p{{Lu}})$")


def _name_word(word: Column, seed: Column, gender: Column, more: Column) -> Column:
    """A name of about the same length in the word's script, or `more` syllables or letters longer;
    the ending tells the gender. An initial becomes a syllable."""
    latin = word.rlike("^[A-Z]")
    drawn = _scrambled(F.concat(word, F.repeat(F.lower(F.regexp_extract(word, r"(\p{L})\P{L}*$", 1)), more)), seed)
    initial = _is_initial(word)
    onset, vowel = "BDFGKLMNPRSTVZ", "aeiou"
    syllables = F.array_join(F.transform(F.sequence(F.lit(0), F.when(initial, 0).otherwise(2) + more), lambda i: F.concat(F.substring(F.lit(onset), 1 + _number(seed, i, len(onset)), F.lit(1)), F.substring(F.lit(vowel), 1 + _number(seed, i + 10, len(vowel)), F.lit(1)))), "")
    ending = F.when(gender == "f", "na").when(gender == "m", "no").otherwise("n")
    stop = F.when(word.endswith("."), ".").otherwise("")
    return F.when(latin & initial, F.concat(F.initcap(F.lower(syllables)), stop)).when(latin, F.concat(F.initcap(F.lower(syllables)), ending)).otherwise(drawn)


def surrogate(key: str, kind: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of the normal form in column entity_: kept apart by key, type and attempt."""
    entity = F.col("entity_")
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string")), 256)
    more = F.floor(attempt / DRAWS_A_LENGTH).cast("int")
    longer = F.repeat(F.lit("a"), more)
    plus = F.regexp_extract(entity, r"^\+\d{1,3}", 0)
    prefix = F.regexp_extract(entity, r"^[^=:]*[=:]\s*[\"']?", 0)
    value = F.substring(entity, F.char_length(prefix) + 1, F.char_length(entity))
    at = F.position(F.lit("."), F.reverse(entity))
    tail = F.right(entity, at)
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: (1 + _number(seed, i, 254)).cast("string")), ".")
    return (
        F.when(kind == "email", F.concat(_scrambled(F.concat(longer, F.left(entity, F.char_length(entity) - at)), seed), tail))
        .when(kind == "secret", F.concat(prefix, _scrambled(F.concat(longer, value), seed, F.lower(value).rlike("^[0-9a-f]+[\"']?$"))))
        .when(kind == "access_key", F.concat(F.left(entity, F.lit(4)), _scrambled(F.expr("substring(entity_, 5)"), seed)))
        .when(kind == "iban", _iban(entity, seed))
        .when(kind == "phone", F.concat(plus, _scrambled(F.substring(entity, F.char_length(plus) + 1, F.char_length(entity)), seed)))
        .when(kind == "card", _card(entity, seed))
        .when(kind == "ip", octets)
        .when(kind == "name", _name_word(entity, seed, gender, more))
        .otherwise(_scrambled(entity, seed))
    )


def _found(docs: DataFrame) -> DataFrame:
    """Rows with entities: doc_id, tag_, the text between them and the entities, in turn."""
    text = whole_text(F.col("text"))
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("tag_"), text.alias("text_"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("entities_"))
    return found.filter(F.size("entities_") > 0).select("doc_id", "tag_", F.split("text_", PATTERN, -1).alias("between_"), "entities_")


def _parts(found: DataFrame) -> DataFrame:
    """tag_, at_, part_, kind_, gender_, entity_: what is replaced, name by name for names.

    entity_ is the normal form: e-mail addresses in lower case, all else as it stands.
    """
    title = F.regexp_extract("raw_", f"^{_TITLE}", 0)
    bare = F.split(F.regexp_replace(F.trim(title), r"\.(?= |$)", ""), " ")
    holds = lambda some: F.arrays_overlap(bare, F.array(*map(F.lit, some)))
    gender = F.when(holds(MALE), "m").when(holds(FEMALE), "f").otherwise("")
    each = found.select("tag_", F.posexplode("entities_").alias("at_", "raw_")).withColumn("kind_", kind_of(F.col("raw_")))
    words = F.when(F.col("kind_") == "name", F.split(F.substring(F.col("raw_"), F.char_length(title) + 1, F.char_length("raw_")), " ")).otherwise(F.array("raw_"))
    rows = each.select("tag_", "at_", "kind_", F.when(F.col("kind_") == "name", gender).otherwise("").alias("title_gender_"), F.when(F.col("kind_") == "name", title).otherwise("").alias("title_"), F.posexplode(words).alias("word_", "raw_"), F.size(words).alias("words_"))
    given = (F.col("words_") >= 2) & (F.col("word_") == 0) & ~F.col("raw_").isin(*PARTICLES) & ~_is_initial(F.col("raw_"))  # only a given name tells the gender
    normal = F.when(F.col("kind_") == "email", F.lower("raw_")).otherwise(F.col("raw_"))
    return rows.select("tag_", "at_", "word_", "kind_", "title_", F.when(given, F.col("title_gender_")).otherwise("").alias("gender_"), normal.alias("entity_"))


def dictionary(parts: DataFrame, key: str = KEY) -> DataFrame:
    """kind_, gender_, entity_, n, surrogate_: one row for each distinct entity, surrogates distinct
    within a type and none of them an entity of that type. Raises if ROUNDS redraws leave some that
    are not."""
    same = ["kind_", "gender_", "entity_"]
    drawn = lambda rows: rows.withColumn("surrogate_", surrogate(key, F.col("kind_"), F.col("gender_"), F.col("attempt_")))
    known = materialise(drawn(parts.groupBy(*same).agg(F.count("*").alias("n")).withColumn("attempt_", F.lit(0))))
    real = known.select("kind_", F.col("entity_").alias("surrogate_")).distinct()
    for drawn_again in range(ROUNDS + 1):
        first = known.groupBy("kind_", "surrogate_").agg(F.min(F.struct("attempt_", *same)).alias("first_"), F.count("*").alias("sharing_"))
        shared = first.filter("sharing_ > 1")
        again = known.join(shared, ["kind_", "surrogate_"]).filter(F.struct("attempt_", *same) != F.col("first_")).select(*same)
        taken = known.join(real, ["kind_", "surrogate_"], "left_semi").select(*same)
        redo = materialise(again.unionByName(taken).distinct())
        if redo.isEmpty():
            break
        if drawn_again == ROUNDS:
            raise RuntimeError(f"surrogates of {redo.count()} entities are not distinct after {ROUNDS} redraws")
        moved = drawn(known.join(redo, same, "left_semi").withColumn("attempt_", F.col("attempt_") + 1))
        known = materialise(known.join(redo, same, "left_anti").unionByName(moved))
    return known.select(*same, "n", "surrogate_")


def _mentions(found: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What else in the same text is a name word that stands after a title there: the parts, where a
    word has one gender a text; the pieces between entities, tag_, at_, piece_, of texts with names;
    and their capitalised words, tag_, at_, word_, raw_, with entity_ and gender_ of mentions.

    A mention may come before the title as well, or be in capitals. Initials and particles alone are
    no mentions.
    """
    is_name = (F.col("kind_") == "name") & ~_is_initial(F.col("entity_")) & ~F.col("entity_").isin(*PARTICLES)
    known = parts.filter(is_name).groupBy("tag_", F.lower("entity_").alias("key_")).agg(F.max("gender_").alias("own_gender_"), F.min("entity_").alias("own_"))
    known = materialise(known)
    one = parts.withColumn("key_", F.when(is_name, F.lower("entity_"))).join(known.drop("own_"), ["tag_", "key_"], "left")
    one = one.withColumn("gender_", F.coalesce("own_gender_", "gender_")).drop("key_", "own_gender_")
    named = found.join(known.select("tag_").distinct(), "tag_", "left_semi")
    pieces = named.select("tag_", F.posexplode("between_").alias("at_", "piece_"))
    words = pieces.select("tag_", "at_", F.posexplode(F.regexp_extract_all("piece_", F.lit(_MENTION), F.lit(0))).alias("word_", "raw_")).withColumn("key_", F.lower("raw_"))
    words = words.join(known, ["tag_", "key_"], "left").select("tag_", "at_", "word_", "raw_", F.col("own_").alias("entity_"), F.col("own_gender_").alias("gender_"))
    return one, pieces, materialise(words)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, kinds, text: the rows of docs that hold entities, with surrogates in place.

    kinds lists the types found, sorted. Each further mention of a name word counts as one more entity.
    Rows without entities, null and empty texts give no row.
    Repeated rows give repeated results; null doc_ids are rows like any other; columns other than
    doc_id and text are ignored. The entities of a text are replaced together, so lengths may change
    and nothing is replaced twice. Particles of names stay.
    """
    found = materialise(_found(docs))
    parts, pieces, words = _mentions(found, materialise(_parts(found)))
    same = ["kind_", "gender_", "entity_"]
    again = words.filter("entity_ is not null").select("tag_", "at_", "word_", F.lit("name").alias("kind_"), F.lit("").alias("title_"), "gender_", "entity_", "raw_")
    every = materialise(parts.withColumn("raw_", F.lit(None).cast("string")).unionByName(again))
    particle = (F.col("kind_") == "name") & F.col("entity_").isin(*PARTICLES)
    drawn = every.filter(~particle)
    placed = lookup(drawn, dictionary(drawn, key), same, "n")
    placed = materialise(placed.unionByName(every.filter(particle).withColumn("n", F.lit(0).cast("long")).withColumn("surrogate_", F.col("entity_"))))
    entity = placed.filter("raw_ is null").groupBy("tag_", "at_").agg(F.max("kind_").alias("kind_"), F.concat(F.max("title_"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_", "surrogate_"))), lambda x: x["surrogate_"]), " ")).alias("new_"))
    texts = entity.groupBy("tag_").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "new_"))), lambda x: x["new_"]).alias("new_"), F.sort_array(F.collect_set("kind_")).alias("kinds"))
    capitals = (F.col("raw_") == F.upper("raw_")) & (F.col("raw_") != F.col("entity_"))
    mention = placed.filter("raw_ is not null").select("tag_", "at_", "word_", F.when(capitals, F.upper("surrogate_")).otherwise(F.col("surrogate_")).alias("new_"))
    put = words.select("tag_", "at_", "word_", "raw_").join(mention, ["tag_", "at_", "word_"], "left")
    put = put.groupBy("tag_", "at_").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_", F.coalesce("new_", "raw_").alias("new_")))), lambda x: x["new_"]).alias("put_"), F.count("new_").alias("mentions_"))
    joined_piece = _woven(F.split("piece_", _MENTION, -1), F.coalesce("put_", F.array().cast("array<string>")))
    whole = pieces.join(put, ["tag_", "at_"], "left").groupBy("tag_").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", joined_piece.alias("piece_")))), lambda x: x["piece_"]).alias("pieces_"), F.sum("mentions_").alias("mentions_"))
    joined = found.join(texts, "tag_").join(whole, "tag_", "left")
    n = F.size("entities_").cast("long") + F.coalesce("mentions_", F.lit(0))
    return joined.select("doc_id", n.alias("n_entities"), "kinds", _woven(F.coalesce("pieces_", "between_"), F.col("new_")).alias("text"))


def _woven(between: Column, put: Column) -> Column:
    """The texts of `between` with those of `put`, one fewer, between them."""
    return F.array_join(F.flatten(F.zip_with(between, F.concat(put, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def op8_pii_surrogates(spark, sf_dir):
    """The documents that hold personal data or secrets, with surrogates in their place."""
    return pseudonymised(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, KEY))

"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of the documents are joined by hash with the k-grams of the templates. A
shared gram votes for a diagonal: its place in the document less its place in the template. Votes
are added up by diagonal, neighbouring diagonals are merged (words may have come in or gone), and a
merged span is accepted if it covers enough of the template's grams in not too many words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, table, whole_text

GRAM = 3
#: Diagonals this far apart are merged; the share of a template's grams that a span needs, and the
#: most words that it may have for each word of the template.
GAP, COVERAGE, STRETCH = 4, 0.8, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the contract, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further phrases and the wording of well-known licences and notices.
OWN = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


# Whole texts of public licences, without their copyright lines.
TEXTS = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
        or altered from any source distribution.""",
    "boost-text": """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
        permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
        part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
        a source language processor.""",
}


def _in_words(text: str) -> str:
    return " ".join(re.findall(WORD, text.lower()))


OWN |= {_in_words(text): label for label, text in TEXTS.items()}


def _templates(spark: SparkSession, gram: int, base: dict[str, str], own: dict[str, str]):
    """Broadcast tables from a gram's hash to where it stands, for whole grams and shorter phrases."""
    rows = []
    for t, (phrase, label) in enumerate([*base.items(), *own.items()]):
        words = phrase.split()
        k = min(gram, len(words))
        rows += [(k, words[i : i + k], t, i, len(words) - k + 1, len(words), label, t < len(base)) for i in range(len(words) - k + 1)]
    places = spark.createDataFrame(rows, "k int, words array<string>, template int, place int, grams int, size int, label string, base boolean")
    hit = F.struct("template", "place", "grams", "size", "label", "base", "words")
    keyed = places.select("k", gram_hash([F.get("words", F.lit(i)) for i in range(gram)]).alias("key_"), hit.alias("hit_"))
    by_size = {k: keyed.filter(F.col("k") == k).groupBy(F.col("key_").alias(f"key{k}_")).agg(F.collect_list("hit_").alias(f"hits{k}_")) for k in sorted({r[0] for r in rows})}
    return by_size


def gram_hash(words: list[Column]) -> Column:
    """Nulls count as absent words, so a gram of fewer words hashes as itself."""
    return F.xxhash64(*words)


def scan(docs: DataFrame, gram: int = GRAM, base: dict[str, str] = BASE, own: dict[str, str] = OWN) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans.

    spans are the accepted ones: label, first and last word, coverage. score is the best coverage of
    any template, 0 without a vote. Null and empty texts have no words, no labels and score 0.
    Repeated rows give repeated results; null doc_ids are rows like any other; columns other than
    doc_id and text are ignored. Templates are constants, so what is broadcast does not grow.
    """
    spark = docs.sparkSession
    text = whole_text(F.col("text"))
    tables = _templates(spark, gram, base, own)
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tag_"), F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)).alias("words_"))
    sized = words.withColumn("n_words", F.size("words_").cast("long"))
    places = F.explode_outer(F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words").cast("int") - 1))).alias("at_")
    at = F.col("at_")
    grams = sized.select("doc_id", "tag_", "n_words", "words_", places).select("doc_id", "tag_", "n_words", at, *[F.get("words_", at + i).alias(f"w{i}_") for i in range(gram)])
    hits = []
    for k, keyed in tables.items():
        own_words = [F.col(f"w{i}_") for i in range(k)]
        grams = grams.withColumn(f"key{k}_", F.when(own_words[-1].isNotNull(), gram_hash(own_words)))
        grams = grams.join(F.broadcast(keyed), f"key{k}_", "left").drop(f"key{k}_")
        hits.append(F.coalesce(f"hits{k}_", F.array().cast(keyed.schema[f"hits{k}_"].dataType)))
    head = at.isNull() | (at == 0)
    found = grams.filter(head | F.greatest(*[F.size(h) for h in hits], F.lit(0)).cast("boolean")).select("doc_id", "tag_", "n_words", at, *[f"w{i}_" for i in range(gram)], F.explode_outer(F.concat(*hits)).alias("hit_"), head.alias("head_"))
    # the words themselves, not their hash, make a vote
    same = F.slice(F.array(*[f"w{i}_" for i in range(gram)]), 1, F.size("hit_.words")) == F.col("hit_.words")
    votes = found.select("doc_id", "tag_", "n_words", at, "head_", F.when(same, F.col("hit_")).alias("hit_"))
    doc = ["doc_id", "tag_"]
    by_diagonal = votes.groupBy(*doc, "n_words", F.col("hit_.template").alias("template"), (at - F.col("hit_.place")).alias("diagonal")).agg(
        F.count_if("head_").alias("heads"),
        F.collect_set("hit_.place").alias("covered"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        *[F.max(f"hit_.{c}").alias(c) for c in ("grams", "size", "label", "base")],
    )
    line = Window.partitionBy(*doc, "template").orderBy("diagonal")
    apart = F.col("size") <= gram  # phrases stand or they don't
    new = (F.lag("diagonal").over(line).isNull() | apart | (F.col("diagonal") - F.lag("diagonal").over(line) > GAP)).cast("int")
    banded = by_diagonal.withColumn("new_", new).withColumn("band", F.sum("new_").over(line))
    spans = banded.groupBy(*doc, "n_words", "template", "band").agg(
        F.max("heads").alias("heads"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        *[F.max(c).alias(c) for c in ("grams", "size", "label", "base")],
    )
    end = F.col("last") + F.least(F.lit(gram), F.col("size")) - 1
    coverage = F.col("covered") / F.col("grams")
    accepted = F.col("template").isNotNull() & (coverage >= COVERAGE) & (end - F.col("first") + 1 <= F.col("size") * STRETCH)
    is_base = accepted & F.col("base")
    # every template and diagonal that the first gram hits has counted the rows
    out = spans.withColumns({"end": end, "coverage": coverage, "accepted": accepted}).groupBy(*doc, "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first").cast("long"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first").cast("long"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(accepted, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.least(coverage, F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(accepted, F.struct("first", "end", "label", "coverage")))).alias("spans"),
        F.max("heads").alias("heads"),
    )
    return out.withColumn("again_", F.explode(F.array_repeat(F.lit(0), F.col("heads").cast("int")))).drop("again_", "heads", "tag_")


def op4_license_scan(spark, sf_dir):
    """Every document with its licence phrases and texts."""
    return scan(table(spark, sf_dir, "documents"))

"""Exact dedup by heavy-hitter split, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table, whole_text

#: Digests that the frequent-items sketch may report, and counters that it keeps.
#: Both are fixed, so that what is broadcast has the same bound at any size.
REPORTED, COUNTERS = 1000, 16384


def exact_groups(docs: DataFrame, reported: int = REPORTED, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A frequent-items sketch of the Misra-Gries family finds candidates for frequent digests in one
    pass with fixed memory. Their sizes and winners are then counted exactly, and broadcast (at most
    `reported` rows), so the rows of frequent digests are settled where they are and never shuffled.
    All other digests are shuffled once, each group then being at most a 1/counters of the rows, and
    settled by a window that spills.

    The row with the largest doc_id of equal texts stays. Null text counts as empty. Null doc_ids
    lose to any other; a group of nulls only has keep_id null and keeps its rows. Rows that repeat
    the winning doc_id are all kept, as nothing tells them apart. Columns other than doc_id and text
    are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = materialise(docs.select("doc_id", F.sha2(whole_text(F.col("text")), 256).alias("text_sha256")))
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {reported}, {counters})").alias("items"))
    frequent = sketch.select(F.explode("items").alias("x")).filter("x.count > 1").select(F.col("x.item").alias("text_sha256"))
    winners = materialise(
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    )
    near = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    far = rest.withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count("*").over(group)})
    every = near.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(far.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id has. Every column stays."""
    losers = exact_groups(docs).filter("not kept").select(F.col("doc_id").alias("lost_id_"), F.col("text_sha256").alias("lost_sha_")).distinct()
    same = docs["doc_id"].eqNullSafe(losers["lost_id_"]) & (F.sha2(whole_text(docs["text"]), 256) == losers["lost_sha_"])
    return docs.join(losers, same, "left_anti")


def op6_exact_dedup(spark, sf_dir):
    """Every document with the one of its group that stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

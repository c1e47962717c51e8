"""Facts derived from the star schema, so that code-graph queries can run on any scale of it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shuffled
from ..shipping import ship


class Facts(NamedTuple):
    symbols: DataFrame
    refs: DataFrame
    opens: DataFrame
    order: DataFrame
    members: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_facts(spark: SparkSession, sf_dir: str) -> Facts:
    """Parts are symbols, line items refs between them, customers imports, nations a compile order."""
    part = read(spark, sf_dir, "part")
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    kinds = ("module", "class", "interface", "record", "union", "type", "value", "member")
    kind = F.lit("function")
    for i, k in reversed(list(enumerate(kinds))):
        kind = F.when(F.col("p_size") % 9 == i, k).otherwise(kind)
    key = F.col("p_partkey")
    symbols = part.select(
        key.alias("id"),
        name.alias("name"),
        F.concat("p_type", F.lit("."), brand, F.lit("."), name).alias("qualified"),
        kind.alias("kind"),
        F.concat(F.lit("src/"), brand, F.lit(".py")).alias("file"),
        (key + 1).cast("int").alias("line"),
        F.lit(1).alias("column"),
        F.when(key % 3 == 0, "public").when(key % 3 == 1, "internal").otherwise("private").alias("visibility"),
        F.lower("p_type").alias("language"),
        F.when(key % 4 == 0, F.concat(F.lit("::"), "p_type")).when(key % 4 == 1, F.col("p_type")).alias("parent"),
        F.when(key % 5 == 0, F.array(F.concat(F.lit("I"), F.initcap("p_type")), F.lit("IThing"))).alias("implements"),
        F.when(key % 2 == 0, F.concat(F.lit("int -> "), "p_type", F.lit(" list"))).alias("type_signature"),
    )
    parts = part.agg(F.count("*").alias("parts_"))
    target = symbols.select(F.col("id").alias("l_partkey"), F.col("name").alias("t_name"), F.col("qualified").alias("t_qualified"))
    site = symbols.select(F.col("id").alias("site_"), "file", "line")
    identity = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = read(spark, sf_dir, "lineitem").join(F.broadcast(parts), F.lit(True))
    items = items.select(identity.alias("id"), (F.col("l_orderkey") % F.col("parts_")).alias("site_"), "l_partkey", "l_linenumber")
    # both joins are shuffled, so rows go in as narrow as they come out
    named = items.join(shuffled(target), "l_partkey").select("id", "site_", F.when(F.col("l_linenumber") % 2 == 0, F.col("t_qualified")).otherwise(F.col("t_name")).alias("name"), "l_linenumber")
    refs = named.join(shuffled(site), "site_").select("id", "name", "file", "line", F.col("l_linenumber").cast("int").alias("column"))
    customer = read(spark, sf_dir, "customer")
    types = F.array(*[F.lit(t) for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    which = F.col("c_custkey") % 6
    opens = customer.filter((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 4 == 0).select(
        F.concat(F.lit("src/Brand_"), (F.col("c_nationkey") % 25 + 1).cast("string"), F.lit(".py")).alias("file"),
        F.concat(F.get(types, which.cast("int")), F.lit(".Brand_"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("module_path"),
        (which + 1).cast("int").alias("ord"),
    )
    nation = read(spark, sf_dir, "nation").filter("n_nationkey < 20")
    order = nation.select(F.concat(F.lit("src/Brand_"), (F.col("n_nationkey") + 1).cast("string"), F.lit(".py")).alias("path"), F.col("n_nationkey").alias("ord"))
    members = part.select(
        key.alias("id"), F.col("p_type").alias("type_name"), name.alias("member_name"), F.lower("p_type").alias("member_type"),
        F.when(key % 4 == 0, "method").when(key % 4 == 1, "field").when(key % 4 == 2, "event").otherwise("property").alias("kind"),
    )
    return Facts(symbols, refs, opens.distinct(), order, members)


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, seq, op, path from the events table; a view is a rename, whose new path it also has."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type").isin("click", "purchase"), "Modified").when(F.col("event_type") == "error", "Deleted").otherwise("Renamed")
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py"))
    new = F.when(op == "Renamed", F.concat(F.lit("src/u"), (F.col("user_id") + 1).cast("string"), F.lit(".py")))
    return e.select("ts", F.col("event_id").alias("seq"), op.alias("op"), path.alias("path"), new.alias("new_path"))


#: The same facts for a SQL engine, as common table expressions.
FACTS_SQL = """
WITH symbols AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name,
  concat(p_type, '.', replace(p_brand, '#', '_'), '.', replace(p_name, ' ', '_')) AS qualified,
  CASE p_size % 9 WHEN 0 THEN 'module' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' WHEN 3 THEN 'record' WHEN 4 THEN 'union'
    WHEN 5 THEN 'type' WHEN 6 THEN 'value' WHEN 7 THEN 'member' ELSE 'function' END AS kind,
  concat('src/', replace(p_brand, '#', '_'), '.py') AS file, CAST(p_partkey + 1 AS INT) AS line, 1 AS col,
  CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'private' END AS visibility, lower(p_type) AS language,
  CASE WHEN p_partkey % 4 = 0 THEN concat('::', p_type) WHEN p_partkey % 4 = 1 THEN p_type END AS parent,
  CASE WHEN p_partkey % 5 = 0 THEN ['I' || p_type[1] || lower(p_type[2:]), 'IThing'] END AS implements,
  CASE WHEN p_partkey % 2 = 0 THEN concat('int -> ', p_type, ' list') END AS type_signature FROM part),
refs AS MATERIALIZED (SELECT row_number() OVER () AS id, CASE WHEN l_linenumber % 2 = 0 THEN t.qualified ELSE t.name END AS name,
  c.file, c.line, l_linenumber AS col
  FROM lineitem JOIN symbols t ON t.id = l_partkey JOIN symbols c ON c.id = l_orderkey % (SELECT count(*) FROM part)),
opens AS (SELECT DISTINCT concat('src/Brand_', c_nationkey % 25 + 1, '.py') AS file,
  concat(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][c_custkey % 6 + 1], '.Brand_', c_custkey % 25 + 1) AS module_path,
  CAST(c_custkey % 6 + 1 AS INT) AS ord FROM customer WHERE (c_custkey * 7 + c_nationkey) % 4 = 0),
file_order AS (SELECT concat('src/Brand_', n_nationkey + 1, '.py') AS path, n_nationkey AS ord FROM nation WHERE n_nationkey < 20),
members AS (SELECT p_partkey AS id, p_type AS type_name, replace(p_name, ' ', '_') AS member_name, lower(p_type) AS member_type,
  CASE p_partkey % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'field' WHEN 2 THEN 'event' ELSE 'property' END AS kind FROM part),
watch_events AS (SELECT ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'click' THEN 'Modified'
  WHEN 'purchase' THEN 'Modified' WHEN 'error' THEN 'Deleted' ELSE 'Renamed' END AS op, concat('src/u', user_id, '.py') AS path,
  CASE WHEN event_type = 'view' THEN concat('src/u', user_id + 1, '.py') END AS new_path FROM events),
tracked AS (SELECT concat('f', o_orderkey) AS path, CAST(o_totalprice AS BIGINT) AS mtime FROM orders WHERE o_orderkey % 3 <> 0),
disk AS (SELECT concat('f', o_orderkey) AS path, CAST(o_totalprice AS BIGINT) + (o_orderkey % 7 = 0)::INT AS mtime FROM orders WHERE o_orderkey % 5 <> 0)
"""

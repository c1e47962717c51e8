"""Queries over a fact store: each makes one in the shared folder, changes it, and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import incremental, projects, rank
from .plans.adapters import Facts
from .registry import ENTRY_SQL, query
from .scratch import shared_folder
from .store import FactStore


def _store(f: Facts, *relations: str) -> FactStore:
    """A new store with the facts of some relations, or of all; the columns that they lack are null."""
    spark = f.symbols.sparkSession
    store = FactStore(spark, f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}", buckets=8).create()
    opens = f.opens.withColumn("id", F.xxhash64("file", "module_path"))
    facts = {"symbols": f.symbols, "refs": f.refs, "opens": opens, "members": f.members, "file_mtimes": _mtimes(f)}
    store.overwrite(**{name: facts[name] for name in relations or facts})
    return store


def _mtimes(f: Facts) -> DataFrame:
    return f.symbols.groupBy(F.col("file").alias("path")).agg(F.max("id").alias("mtime"))


@query("""SELECT 'symbols' AS relation, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(DISTINCT file) AS files FROM symbols UNION ALL SELECT 'refs', count(*), 0, count(DISTINCT file) FROM refs
UNION ALL SELECT 'opens', count(*), 0, count(DISTINCT file) FROM opens UNION ALL SELECT 'members', count(*), CAST(sum(id) AS BIGINT), 0 FROM members UNION ALL SELECT 'file_mtimes', count(DISTINCT file), 0, count(DISTINCT file) FROM symbols""")
def store_bulk(f):
    """All relations written in bulk, opened anew and read."""
    store = FactStore(f.symbols.sparkSession, _store(f).path, buckets=8).open_or_create()
    none, out = F.lit(0).cast("long"), None
    for name, ids, files in (("symbols", F.sum("id"), F.count_distinct("file")), ("refs", none, F.count_distinct("file")), ("opens", none, F.count_distinct("file")), ("members", F.sum("id"), none), ("file_mtimes", none, F.count_distinct("path"))):
        own = store.read(name).agg(F.lit(name).alias("relation"), F.count("*").alias("n"), (F.max(none) if ids is none else ids).alias("ids"), (F.max(none) if files is none else files).alias("files"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT id, name, qualified, kind, file, line, visibility, language, parent, type_signature FROM symbols UNION ALL SELECT 1000000000, 'added', 'X.added', 'function', 'src/new.py', 3, 'public', 'promo', NULL, 'int'")
def store_insert_symbol(f):
    """One typed symbol added to a store; nothing that is there is written again."""
    store = _store(f, "symbols")
    row = f.symbols.sparkSession.createDataFrame([(1_000_000_000, "added", "X.added", "function", "int", "src/new.py", 3, 1, "public", "promo")], "id long, name string, qualified string, kind string, type_signature string, file string, line int, column int, visibility string, language string")
    store.append("symbols", row)
    return store.read("symbols").select("id", "name", "qualified", "kind", "file", "line", "visibility", "language", "parent", "type_signature")


@query("""SELECT 'refs' AS relation, count(*) + 1 AS n, 'src/new.py' AS last_file FROM refs UNION ALL SELECT 'opens', count(*) + 1, 'src/new.py' FROM opens UNION ALL SELECT 'members', count(*) + 1, 'added' FROM members""")
def store_insert_facts(f):
    """One ref, one open and one member added."""
    store, spark = _store(f, "refs", "opens", "members"), f.symbols.sparkSession
    store.append("refs", spark.createDataFrame([(-1, "added", "src/new.py", 1, 1)], "id long, name string, file string, line int, column int"))
    store.append("opens", spark.createDataFrame([(-1, "src/new.py", "X", 1)], "id long, file string, module_path string, ord int"))
    store.append("members", spark.createDataFrame([(-1, "X", "added", "int", "method")], "id long, type_name string, member_name string, member_type string, kind string"))
    out = None
    for name, test, shown in (("refs", "name = 'added'", "file"), ("opens", "module_path = 'X'", "file"), ("members", "type_name = 'X'", "member_name")):
        own = store.read(name).agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.max(F.when(F.expr(test), F.col(shown))).alias("last_file"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT 'deleted' AS step, count(*) AS n FROM members WHERE type_name <> 'PROMO' UNION ALL SELECT 'cleared', 0")
def store_members(f):
    """The members of one type deleted; then all of them."""
    store = _store(f, "members")
    store.delete_where("members", "type_name = 'PROMO'")
    deleted = store.read("members").agg(F.lit("deleted").alias("step"), F.count("*").alias("n"))
    n = deleted.first()["n"]
    store.overwrite(members=f.members.limit(0))
    left = store.read("members").agg(F.lit("cleared").alias("step"), F.count("*").alias("n"))
    return left.unionByName(f.symbols.sparkSession.createDataFrame([("deleted", n)], "step string, n long"))


@query("""SELECT path, CASE WHEN path = 'src/Brand_9.py' THEN 77 ELSE mtime END AS mtime FROM (SELECT file AS path, max(id) AS mtime FROM symbols GROUP BY 1) WHERE path <> 'src/Brand_7.py'
UNION ALL SELECT 'point', (SELECT max(id) FROM symbols WHERE file = 'src/Brand_8.py') UNION ALL SELECT 'tracked', count(DISTINCT file) - 1 FROM symbols UNION ALL SELECT 'cleared', 0""")
def store_mtimes(f):
    """A time set, one deleted with its file, one looked up, the tracked files counted, all cleared."""
    store, spark = _store(f, "file_mtimes"), f.symbols.sparkSession
    store.set_mtimes(spark.createDataFrame([("src/Brand_9.py", 77)], "path string, mtime long"))
    store.replace_files(spark.createDataFrame([("src/Brand_7.py",)], "path string"), {"file_mtimes": spark.createDataFrame([], "path string, mtime long")})
    after = store.read("file_mtimes")
    facts = [("point", store.mtime_of("src/Brand_8.py")), ("tracked", store.tracked_files().count())]
    store.overwrite(file_mtimes=after.limit(0))
    facts.append(("cleared", store.read("file_mtimes").count()))
    return after.unionByName(spark.createDataFrame(facts, "path string, mtime long"))


@query("SELECT 'schema_version' AS key, '4' AS value UNION ALL SELECT 'root', '/b' UNION ALL SELECT 'missing', NULL")
def store_metadata(f):
    store, spark = _store(f, "file_mtimes"), f.symbols.sparkSession
    store.set_metadata("root", "/a")
    store.set_metadata("root", "/b")
    missing = spark.createDataFrame([("missing", store.metadata("missing"))], "key string, value string")
    return store.read("metadata").unionByName(missing)


@query("SELECT id, file FROM symbols WHERE file NOT IN ('src/Brand_7.py', 'src/Brand_8.py') UNION ALL SELECT -1, 'src/Brand_7.py'")
def store_replace_file(f):
    """A file saved anew and another cleared; what a writer wrote that never came to its pointer
    leaves no trace."""
    store, spark = _store(f, "symbols"), f.symbols.sparkSession
    seven, eight = (spark.createDataFrame([(f"src/Brand_{i}.py",)], "path string") for i in (7, 8))
    fresh = f.symbols.filter("file = 'src/Brand_7.py'").limit(1).withColumn("id", F.lit(-1).cast("long"))
    with store.writer():
        store.replace_files(seven, {"symbols": fresh})
        store._write("symbols", fresh.withColumn("id", F.lit(-2).cast("long")))
        store.clear_files(eight)
    return store.read("symbols").select("id", "file")


@query("SELECT count(DISTINCT path) AS n FROM (SELECT file AS path, max(id) AS mtime FROM symbols GROUP BY 1) WHERE mtime > (SELECT count(*) - 5 FROM symbols)")
def store_is_stale(f):
    """The files that changed after the store was written."""
    return incremental.is_stale(_mtimes(f), f.symbols.count() - 5).agg(F.count_distinct("path").alias("n"))


@query("SELECT count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT CASE WHEN type_signature IS NOT NULL THEN qualified END) AS typed, (SELECT count(DISTINCT type_name) FROM members) AS types, (SELECT count(*) FROM members) AS members FROM symbols")
def type_summary(f):
    return projects.type_summary(f.symbols, f.members)


@query(f"""SELECT project, qualified, id FROM (SELECT language AS project, qualified, id, row_number() OVER (PARTITION BY language ORDER BY id) AS place FROM symbols WHERE qualified = {ENTRY_SQL}) WHERE place = 1
UNION ALL SELECT project, qualified, id FROM (SELECT language AS project, name, qualified, id, row_number() OVER (PARTITION BY language ORDER BY id) AS place FROM symbols
WHERE lower(name) = lower({ENTRY_SQL}) OR lower(qualified) = lower({ENTRY_SQL})) WHERE place <= 10 AND (name = {ENTRY_SQL} OR qualified = {ENTRY_SQL}) AND project NOT IN (SELECT language FROM symbols WHERE qualified = {ENTRY_SQL})""")
def definitions_exact(f):
    """A qualified name in every project; here languages stand for projects."""
    entry = f.symbols.filter("id = 0").first()["qualified"]
    return projects.definitions(f.symbols.withColumn("project", F.col("language")), entry).select("project", "qualified", "id")


@query("""SELECT project, qualified, id FROM (SELECT language AS project, name, qualified, id, row_number() OVER (PARTITION BY language ORDER BY id) AS place FROM symbols
WHERE lower(name) = 'hot_gear' OR lower(qualified) = 'hot_gear') WHERE place <= 10 AND name = 'hot_gear'""")
def definitions_searched(f):
    return projects.definitions(f.symbols.withColumn("project", F.col("language")), "hot_gear").select("project", "qualified", "id")


@query("SELECT file FROM (SELECT DISTINCT file FROM symbols)")
def tracked_files(f):
    return _store(f, "file_mtimes").tracked_files().select(F.col("path").alias("file"))


@query("""SELECT file, count(*) AS n FROM symbols WHERE kind IN ('class', 'module', 'interface', 'record', 'union') GROUP BY file""")
def describe_full(f):
    """The project at full detail: how many of each file's symbols count."""
    full = rank.describe(f.symbols, f.refs, "full")
    return full.groupBy("file").agg(F.max("place").alias("shown"), F.max("more").alias("more")).select("file", (F.col("shown") + F.col("more")).cast("long").alias("n"))



"""Every registered query over the derived facts, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import history, stack, text
from .operators import editor, graph, incremental, lookup, rank, refs, search
from .plans.adapters import Facts, read, star_facts, watch_events
from .registry import ENTRY_SQL, oracle_sql, queries, query
from .scratch import shuffled
from .streaming import watch
from . import catalog_extract, catalog_resolve, catalog_store, catalog_text  # noqa: F401  (they register their queries)

__all__ = ["oracle_sql", "queries"]

#: qualified, sym columns that most answers show.
SYM = ["id", "name", "qualified", "kind", "file", "line"]
_SYM_SQL = "id, name, qualified, kind, file, line"


def _entry(f: Facts) -> str:
    return f.symbols.filter("id = 0").first()["qualified"]


# --- lookups -------------------------------------------------------------------------------------


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE qualified = {ENTRY_SQL} ORDER BY id LIMIT 1")
def symbol_exact_first(f):
    return lookup.find_first(f.symbols, _entry(f)).select(*SYM)


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE qualified = {ENTRY_SQL}")
def symbol_exact_all(f):
    return lookup.find_all(f.symbols, _entry(f)).select(*SYM)


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE qualified = {ENTRY_SQL} ORDER BY id DESC LIMIT 1")
def symbol_last(f):
    return lookup.get_last(f.symbols, _entry(f)).select(*SYM)


@query(f"SELECT {_SYM_SQL.replace('file', chr(39) + '/work/' + chr(39) + ' || file AS file')} FROM symbols WHERE qualified = {ENTRY_SQL} ORDER BY id DESC LIMIT 1")
def symbol_absolute(f):
    return lookup.get_absolute(f.symbols, _entry(f), "/work").select(*SYM)


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE file = 'src/Brand_7.py'")
def symbols_in_file(f):
    return lookup.in_file(f.symbols, "src/Brand_7.py").select(*SYM)


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE qualified IN (SELECT qualified FROM symbols WHERE file = 'src/Brand_7.py')")
def symbols_in_file_indexed(f):
    return lookup.symbols_in_file_indexed(f.symbols, "src/Brand_7.py").select(*SYM)


@query("SELECT name, file, line, col AS \"column\" FROM refs WHERE file = 'src/Brand_7.py'")
def refs_in_file(f):
    return lookup.in_file(f.refs, "src/Brand_7.py").select("name", "file", "line", "column")


@query("SELECT module_path, ord FROM opens WHERE file = 'src/Brand_7.py'")
def opens_for_file(f):
    return lookup.opens_for_file(f.opens, "src/Brand_7.py")


@query(f"SELECT qualified, type_signature FROM symbols WHERE qualified = {ENTRY_SQL} AND type_signature IS NOT NULL ORDER BY id LIMIT 1")
def symbol_type(f):
    return lookup.symbol_type(f.symbols, _entry(f))


@query("SELECT * FROM members WHERE type_name = 'PROMO'")
def members_of_type(f):
    return lookup.members_of(f.members, "PROMO")


@query("SELECT * FROM members WHERE type_name = 'PROMO' AND member_name = 'hot_gear' ORDER BY id LIMIT 1")
def one_member(f):
    return lookup.member(f.members, "PROMO", "hot_gear")


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE starts_with(qualified, 'SMALL.Brand_4.') OR qualified = 'SMALL.Brand_4'")
def symbols_in_module(f):
    return lookup.symbols_in_module(f.symbols, "SMALL.Brand_4").select(*SYM)


@query("SELECT coalesce(bool_or(file = 'src/Brand_7.py'), false) AS contains_file FROM symbols")
def contains_file(f):
    return lookup.contains_file(f.symbols, "src/Brand_7.py")


@query("SELECT DISTINCT file AS path FROM symbols LEFT JOIN file_order o ON o.path = file WHERE o.ord < (SELECT ord FROM file_order WHERE path = 'src/Brand_9.py')")
def visible_files(f):
    return lookup.visible_files(f.symbols.select(F.col("file").alias("path")), f.order, "src/Brand_9.py")


@query("""SELECT p.from_file, p.to_file, coalesce(y.ord < x.ord, true) AS can_reference
FROM (SELECT DISTINCT r.file AS from_file, s.file AS to_file FROM refs r JOIN symbols s ON s.qualified = r.name) p
LEFT JOIN file_order x ON x.path = p.from_file LEFT JOIN file_order y ON y.path = p.to_file""")
def can_reference(f):
    """For each file and every file with a symbol that it refers to."""
    named, homes = f.refs.select("name", F.col("file").alias("from_file")).distinct(), f.symbols.select(F.col("qualified").alias("name"), F.col("file").alias("to_file")).distinct()
    return lookup.can_reference(named.join(homes, "name").select("from_file", "to_file").distinct(), f.order)


@query(f"SELECT {_SYM_SQL}, parent FROM symbols WHERE parent IN ('PROMO', '::PROMO')")
def subclasses(f):
    return lookup.subclasses(f.symbols, "PROMO").select(*SYM, "parent")


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE len(list_filter(implements, lambda x: lower(x) LIKE 'ism%')) > 0")
def implementers(f):
    return lookup.implementers(f.symbols, "ISm").select(*SYM)


@query("SELECT name, file, line, col AS \"column\" FROM refs WHERE file = 'src' OR starts_with(file, 'src/')")
def refs_under_path(f):
    return lookup.refs_under(f.refs, "src").select("name", "file", "line", "column")


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE language = 'promo'")
def language_filter(f):
    return lookup.of_language(f.symbols, "promo").select(*SYM)


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE kind IN ('class', 'module', 'interface', 'record', 'union')")
def significant_symbols(f):
    return lookup.significant(f.symbols).select(*SYM)


@query("SELECT DISTINCT file FROM symbols")
def distinct_files(f):
    return lookup.distinct_files(f.symbols)


@query(f"SELECT {_SYM_SQL} FROM symbols")
def all_symbols_ordered(f):
    return lookup.all_ordered(f.symbols).select(*SYM)


@query("""SELECT s.file, max_by(p.root, length(p.root)) AS root FROM (SELECT DISTINCT file FROM symbols) s
JOIN (VALUES ('src'), ('src/Brand_1.py'), ('sr')) p(root) ON s.file = p.root OR starts_with(s.file, p.root || '/') GROUP BY s.file""")
def project_for_file(f):
    roots = f.symbols.sparkSession.createDataFrame([("src",), ("src/Brand_1.py",), ("sr",)], "root string")
    return lookup.project_for_file(lookup.distinct_files(f.symbols), roots)


# --- search --------------------------------------------------------------------------------------


def _like_sql(pattern: str) -> str:
    return f"(lower(name) LIKE '{pattern}' OR lower(qualified) LIKE '{pattern}')"


def _search(name: str, pattern: str, limit: int, language: str | None = None) -> None:
    also = f" AND language = '{language}'" if language else ""
    sql = f"SELECT {_SYM_SQL} FROM symbols WHERE {_like_sql(text.glob_to_like(pattern.lower()))}{also} ORDER BY id LIMIT {limit}"

    def run(f):
        return search.search(f.symbols, pattern, limit, language).select(*SYM)

    run.__name__ = name
    query(sql)(run)


_search("search_prefix", "Hot*", 50)
_search("search_suffix", "*GEAR", 1000)
_search("search_contains", "*brand_1*", 1000)
_search("search_single_char", "re?_widget", 100)
_search("search_in_language", "*ring", 500, "promo")


@query(f"""SELECT {_SYM_SQL}, row_number() OVER (ORDER BY lower(name) = 'hot_g' DESC, starts_with(lower(name), 'hot_g') DESC, strlen(name), qualified, id) AS place
FROM symbols WHERE starts_with(lower(name), 'hot_g') OR contains(lower(qualified), 'hot_g') ORDER BY place LIMIT 50""")
def search_ranked(f):
    top = search.search_ranked(f.symbols, "Hot_g").limit(50)
    from pyspark.sql.window import Window

    # over the fifty rows of the answer only
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.lower("name") == "hot_g"), F.desc(F.lower("name").startswith("hot_g")), F.octet_length("name"), "qualified", "id")
    return top.withColumn("place", F.row_number().over(w)).select(*SYM, "place")


@query(f"SELECT {_SYM_SQL} FROM symbols WHERE list_contains(list_transform(regexp_split_to_array(lower(name || ' ' || qualified), '[^a-z0-9_]+'), lambda w: starts_with(w, 'hot')), true)")
def fts_prefix(f):
    return search.search_text(f.symbols, "hot*", None).select(*SYM)


@query(f""", worded AS (SELECT *, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9_]+') || regexp_split_to_array(lower(qualified), '[^a-z0-9_]+'), lambda w: w <> '') AS words FROM symbols),
counted AS (SELECT *, len(words) AS size, len(list_filter(words, lambda w: w = 'promo')) AS c0, len(list_filter(words, lambda w: starts_with(w, 'brand_1'))) AS c1 FROM worded),
stats AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (c0 > 0) AS df0, count(*) FILTER (c1 > 0) AS df1 FROM counted),
scored AS (SELECT {_SYM_SQL}, greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * size / mean))
  + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * size / mean)) AS rank FROM counted, stats WHERE c0 > 0 AND c1 > 0)
SELECT {_SYM_SQL}, round(CAST(rank AS DOUBLE), 6) AS rank FROM scored""")
def fts_bm25(f):
    return search.search_words(f.symbols, "promo brand_1*", None).select(*SYM, F.round("rank", 6).alias("rank"))


@query(f"""SELECT {_SYM_SQL}, least(levenshtein('hot_gaer', name), levenshtein('hot_gaer', qualified)) AS distance FROM symbols
WHERE least(levenshtein('hot_gaer', name), levenshtein('hot_gaer', qualified)) <= 3 ORDER BY distance, id LIMIT 60""")
def fuzzy_search(f):
    return search.fuzzy_search(f.symbols, "hot_gaer", 3, 60).select(*SYM, F.col("distance").cast("long").alias("distance"))


@query("""SELECT value, levenshtein('hot_gaer', value) AS distance FROM (SELECT name AS value FROM symbols UNION SELECT qualified FROM symbols)
WHERE levenshtein('hot_gaer', value) BETWEEN 1 AND 4 ORDER BY distance, value LIMIT 5""")
def suggest_similar(f):
    return search.suggest_similar(f.symbols, "hot_gaer", 4).select("value", F.col("distance").cast("long").alias("distance"))


@query("SELECT name AS value FROM symbols UNION SELECT qualified FROM symbols")
def all_names(f):
    return search.all_names(f.symbols)


@query(f"SELECT {_SYM_SQL} FROM (SELECT * FROM symbols WHERE {_like_sql('%gear%')} ORDER BY id LIMIT 20)")
def tool_search(f):
    return search.tool_search(f.symbols, "*gear*").select(*SYM)


@query(f"""SELECT {_SYM_SQL}, project, place FROM (SELECT *, language AS project, row_number() OVER (PARTITION BY language ORDER BY id) AS place
FROM symbols WHERE {_like_sql('%gear')}) WHERE place <= 5""")
def multi_project_topk(f):
    return search.search_projects(f.symbols.withColumn("project", F.col("language")), "*gear", 5).select(*SYM, "project", F.col("place").cast("long").alias("place"))


@query(f"""SELECT {_SYM_SQL}, project, place FROM (SELECT *, language AS project, row_number() OVER (PARTITION BY language ORDER BY levenshtein('hot_gaer', name), id) AS place
FROM symbols WHERE levenshtein('hot_gaer', name) <= 3) WHERE place <= 4""")
def multi_project_fuzzy(f):
    return search.fuzzy_search_projects(f.symbols.withColumn("project", F.col("language")), "hot_gaer", 4).select(*SYM, "project", F.col("place").cast("long").alias("place"))


@query(f"SELECT qualified, file, line, 0 AS branch FROM symbols WHERE qualified = {ENTRY_SQL} ORDER BY id LIMIT 1")
def definition_exact(f):
    return search.definition(f.symbols, _entry(f)).select("qualified", "file", "line", "branch")


@query("SELECT qualified, file, line, 1 AS branch FROM symbols WHERE lower(name) LIKE 'hot_gear' OR lower(qualified) LIKE 'hot_gear' ORDER BY id LIMIT 1")
def definition_cascade(f):
    return search.definition(f.symbols, "hot_gear").select("qualified", "file", "line", "branch")


@query("""SELECT qualified, file, line, CAST(0.5 AS DOUBLE) AS confidence, 'fuzzy' AS match FROM symbols
WHERE least(levenshtein('hot_gaer', name), levenshtein('hot_gaer', qualified)) <= 3 ORDER BY least(levenshtein('hot_gaer', name), levenshtein('hot_gaer', qualified)), id LIMIT 5""")
def tool_definition(f):
    return search.tool_definition(f.symbols, "hot_gaer")


@query("SELECT qualified, name FROM symbols WHERE starts_with(lower(name), 'hot') OR contains(lower(qualified), 'hot') ORDER BY starts_with(lower(name), 'hot') DESC, strlen(name), qualified, id LIMIT 50")
def workspace_symbol(f):
    return search.search_ranked(f.symbols, "hot").limit(50).select("qualified", "name")


# --- references and graph ------------------------------------------------------------------------


@query("SELECT name, file, line, col AS \"column\" FROM refs WHERE name = 'hot_gear' OR lower(name) LIKE '%.hot_gear' OR lower(name) LIKE '%::hot_gear' OR lower(name) LIKE '%\\hot_gear'")
def find_references(f):
    return refs.find_references(f.refs, "hot_gear").select("name", "file", "line", "column")


@query(f"""SELECT r.name, r.file, r.line, r.col AS "column" FROM refs r JOIN (SELECT qualified AS t, name AS s FROM symbols WHERE qualified = {ENTRY_SQL} ORDER BY id LIMIT 1)
ON r.name = s OR r.name = t OR ends_with(t, '.' || r.name) OR ends_with(r.name, '.' || s)""")
def find_references_defined(f):
    return refs.find_references_defined(f.symbols, f.refs, _entry(f)).select("name", "file", "line", "column")


_CONTAINED_SQL = """, held AS (SELECT r.id, r.name, r.file, r.line, r.col, (SELECT max_by(s.qualified, CAST(s.line AS BIGINT) * 100000000 + s.id) FROM symbols s
  WHERE s.file = r.file AND s.kind IN ('function', 'member') AND s.line <= r.line) AS container FROM refs r)"""


@query(_CONTAINED_SQL + ' SELECT name, file, line, col AS "column", container FROM held')
def containing_symbol(f):
    return refs.containing_symbol(f.symbols, f.refs).select("name", "file", "line", "column", "container")


_CALLERS_SQL = """, short AS (SELECT qualified, min_by(name, id) AS short FROM symbols GROUP BY qualified),
pairs AS (SELECT DISTINCT s.qualified AS target, h.container FROM held h JOIN short s ON string_split(h.name, '.')[-1] = s.short
  WHERE h.container IS NOT NULL)"""


@query(_CONTAINED_SQL + _CALLERS_SQL + f" SELECT DISTINCT container AS qualified FROM pairs WHERE target = {ENTRY_SQL} AND container <> target")
def callers(f):
    return graph.callers(f.symbols, f.refs, _entry(f))


@query(_CONTAINED_SQL + _CALLERS_SQL + f""", d1 AS (SELECT DISTINCT container AS q FROM pairs WHERE target = {ENTRY_SQL} AND container <> target),
d2 AS (SELECT DISTINCT container AS q FROM pairs WHERE target IN (SELECT q FROM d1) AND container NOT IN (SELECT q FROM d1) AND container <> {ENTRY_SQL})
SELECT {ENTRY_SQL} AS qualified, 0 AS depth UNION ALL SELECT q, 1 FROM d1 UNION ALL SELECT q, 2 FROM d2""")
def reverse_spider_depth2(f):
    return graph.reverse_spider(f.symbols, f.refs, _entry(f), 2)


_EDGES_SQL = """, wanted AS (SELECT DISTINCT file, name FROM refs), known AS (SELECT DISTINCT qualified FROM symbols),
found AS (SELECT w.file, w.name, coalesce(min(k.qualified), arg_min(m.qualified, {'o': o.ord, 'q': m.qualified})) AS target FROM wanted w LEFT JOIN known k ON k.qualified = w.name
  LEFT JOIN opens o ON o.file = w.file AND k.qualified IS NULL LEFT JOIN known m ON m.qualified = o.module_path || '.' || w.name AND o.file IS NOT NULL GROUP BY 1, 2),
leftover AS (SELECT DISTINCT name FROM found WHERE target IS NULL),
hits AS (SELECT l.name, arg_min(s.qualified, {'a': lower(s.name) <> lower(l.name), 'b': NOT starts_with(lower(s.name), lower(l.name)), 'c': strlen(s.name), 'd': s.qualified, 'e': s.id}) AS target
  FROM leftover l JOIN symbols s ON starts_with(lower(s.name), lower(l.name)) OR contains(lower(s.qualified), lower(l.name)) GROUP BY 1),
edges AS (SELECT f.file, f.name, coalesce(f.target, h.target) AS target FROM found f LEFT JOIN hits h USING (name))"""


@query(_EDGES_SQL + " SELECT * FROM edges")
def resolve_refs(f):
    return graph.resolve_refs(f.symbols, f.opens, f.refs)


_SPIDER_SQL = _EDGES_SQL + f""", home AS (SELECT qualified, arg_max(file, id) AS file FROM symbols GROUP BY 1),
d0 AS (SELECT {ENTRY_SQL} AS q),
d1 AS (SELECT DISTINCT target AS q FROM edges WHERE target IS NOT NULL AND file IN (SELECT file FROM home JOIN d0 ON qualified = q) AND target NOT IN (SELECT q FROM d0)),
d2 AS (SELECT DISTINCT target AS q FROM edges WHERE target IS NOT NULL AND file IN (SELECT file FROM home JOIN d1 ON qualified = q) AND target NOT IN (SELECT q FROM d0) AND target NOT IN (SELECT q FROM d1)),
nodes AS (SELECT q AS qualified, 0 AS depth FROM d0 UNION ALL SELECT q, 1 FROM d1 UNION ALL SELECT q, 2 FROM d2)"""


@query(_SPIDER_SQL + " SELECT qualified, depth FROM nodes")
def spider_depth2(f):
    return graph.spider(f.symbols, f.refs, f.opens, _entry(f), 2)


@query(_SPIDER_SQL + """ SELECT n.depth, n.qualified, repeat('  ', n.depth) || n.qualified || ' (' || s.file || ':' || s.line || ')' AS line_text
FROM nodes n JOIN symbols s ON s.id = (SELECT max(id) FROM symbols x WHERE x.qualified = n.qualified) WHERE n.depth <= 1""")
def spider_formatted(f):
    nodes = graph.spider(f.symbols, f.refs, f.opens, _entry(f), 1)
    return graph.formatted(nodes, f.symbols)


@query(_SPIDER_SQL + " SELECT DISTINCT file FROM home JOIN nodes USING (qualified) WHERE depth <= 1")
def spider_files(f):
    return graph.files_touched(graph.spider(f.symbols, f.refs, f.opens, _entry(f), 1), f.symbols)


@query(_EDGES_SQL + """, home AS (SELECT qualified, arg_max(file, id) AS file FROM symbols GROUP BY 1), known_edges AS (SELECT file, target FROM edges WHERE target IS NOT NULL),
w0 AS (SELECT min(id) AS root, qualified AS q FROM symbols WHERE file = 'src/Brand_7.py' GROUP BY 2),
w1 AS (SELECT DISTINCT root, target AS q FROM w0 JOIN home ON qualified = q JOIN known_edges USING (file) WHERE (root, target) NOT IN (SELECT (root, q) FROM w0)),
w2 AS (SELECT DISTINCT root, target AS q FROM (SELECT DISTINCT root, file FROM w1 JOIN home ON qualified = q) JOIN known_edges USING (file)),
walks AS (SELECT root, q, 0 AS depth FROM w0 UNION ALL SELECT root, q, 1 FROM w1 UNION ALL SELECT root, q, 2 FROM w2), least AS (SELECT root, q, min(depth) AS depth FROM walks GROUP BY 1, 2)
SELECT q AS qualified, arg_min(depth, root) AS depth FROM least GROUP BY 1""")
def spider_from_file(f):
    return graph.spider_from_file(f.symbols, f.refs, f.opens, "src/Brand_7.py", 2)


@query("""SELECT r.name, r.file, r.line, r.col AS "column", coalesce((SELECT arg_min(s.file, s.id) FROM symbols s WHERE s.qualified = r.name), '<external>') AS defined_in
FROM refs r WHERE r.file = 'src/Brand_7.py'""")
def refs_resolved_or_external(f):
    return refs.refs_resolved_or_external(f.symbols, f.refs, "src/Brand_7.py")


@query(_CONTAINED_SQL + _CALLERS_SQL + _SPIDER_SQL + f""" SELECT s.qualified, s.kind, s.file, s.line,
array_to_string(list_sort((SELECT list(DISTINCT container) FROM pairs WHERE target = {ENTRY_SQL} AND container <> target)), ',') AS callers,
array_to_string(list_sort((SELECT list(q) FROM d1)), ',') AS dependencies FROM symbols s WHERE id = 0""")
def enrich(f):
    out = graph.enrich(f.symbols, f.refs, f.opens, _entry(f))
    return out.withColumns({c: F.array_join(c, ",") for c in ("callers", "dependencies")})


@query("""SELECT file, line, col AS "column", 'renamed' AS new_text FROM symbols WHERE qualified = """ + ENTRY_SQL + f"""
UNION SELECT r.file, r.line, r.col, CASE WHEN contains(r.name, '.') THEN regexp_extract(r.name, '^(.*\\.)[^.]*$', 1) ELSE '' END || 'renamed' FROM refs r JOIN (SELECT qualified AS t, name AS s FROM symbols WHERE qualified = {ENTRY_SQL} ORDER BY id LIMIT 1)
ON string_split(r.name, '.')[-1] = s""")
def rename_plan(f):
    return graph.rename_plan(f.symbols, f.refs, _entry(f), "renamed").withColumn("column", F.col("column").cast("int"))


@query(_EDGES_SQL + """, asked AS (SELECT * FROM edges WHERE file = 'src/Brand_7.py' AND target IS NOT NULL AND name NOT IN (SELECT qualified FROM symbols))
SELECT DISTINCT regexp_extract(target, '^(.*)[.][^.]*$', 1) AS module FROM asked
WHERE contains(target, '.') AND regexp_extract(target, '^(.*)[.][^.]*$', 1) NOT IN (SELECT module_path FROM opens WHERE file = 'src/Brand_7.py')""")
def missing_opens(f):
    return graph.missing_opens(f.symbols, f.opens, f.refs, "src/Brand_7.py")


# --- ranking -------------------------------------------------------------------------------------

_COUNTS_SQL = """, keyed AS (SELECT qualified, unnest(list_distinct([name, qualified])) AS key FROM symbols),
counts AS (SELECT k.qualified, count(DISTINCT r.file) AS file_diversity, count(r.id) AS total_refs FROM keyed k LEFT JOIN refs r ON r.name = k.key GROUP BY 1),
firsts AS (SELECT qualified, arg_min(kind, id) AS kind, arg_min(visibility, id) AS visibility FROM symbols GROUP BY 1),
ranked AS (SELECT * FROM firsts JOIN counts USING (qualified))"""
_KIND_SQL = "CASE WHEN kind = 'module' THEN 5 WHEN kind IN ('class', 'interface') THEN 4 WHEN kind IN ('record', 'union') THEN 3 WHEN kind IN ('type', 'function') THEN 2 ELSE 1 END"
_VIS_SQL = "CASE visibility WHEN 'public' THEN 3 WHEN 'internal' THEN 2 ELSE 1 END"


@query("SELECT count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT qualified) AS names FROM symbols")
def count_symbols(f):
    return rank.totals(f.symbols)


@query("SELECT count(DISTINCT file) AS file_diversity, count(*) AS total_refs FROM refs WHERE name IN ('hot_gear', 'PROMO.Brand_1.hot_gear')")
def symbol_ref_counts(f):
    return rank.symbol_reference_counts(f.refs, "hot_gear", "PROMO.Brand_1.hot_gear")


@query(_COUNTS_SQL + f" SELECT qualified, kind, visibility, file_diversity, total_refs FROM ranked ORDER BY file_diversity DESC, {_KIND_SQL} DESC, {_VIS_SQL} DESC, total_refs DESC, qualified LIMIT 50")
def rank_symbols(f):
    return rank.rank_symbols(f.symbols, f.refs, 50).select("qualified", "kind", "visibility", "file_diversity", "total_refs")


@query(_COUNTS_SQL + f" SELECT qualified, round(file_diversity * 1.0 + {_KIND_SQL} * 0.3 + {_VIS_SQL} * 0.1 + CASE WHEN total_refs > 0 THEN ln(total_refs) * 0.1 ELSE 0 END, 6) AS score FROM ranked")
def importance_score(f):
    return rank.with_counts(f.symbols, f.refs).select("qualified", F.round("score", 6).alias("score"))


@query(_COUNTS_SQL + """ SELECT file, qualified, id, place FROM (SELECT s.file, s.qualified, s.id, row_number() OVER (PARTITION BY s.file ORDER BY c.file_diversity DESC,
CASE WHEN s.kind = 'module' THEN 5 WHEN s.kind IN ('class', 'interface') THEN 4 WHEN s.kind IN ('record', 'union') THEN 3 ELSE 1 END DESC, c.total_refs DESC, s.qualified, s.id) AS place
FROM symbols s JOIN counts c USING (qualified)) WHERE place <= 5""")
def rank_per_file(f):
    return rank.rank_per_file(f.symbols, f.refs, 5).select("file", "qualified", "id", F.col("place").cast("long").alias("place"))


@query(_COUNTS_SQL + f""" SELECT file, count(*) AS n, max(file_diversity) AS best FROM (SELECT r.*, (SELECT arg_min(file, id) FROM symbols s WHERE s.qualified = r.qualified) AS file FROM ranked r
ORDER BY file_diversity DESC, {_KIND_SQL} DESC, {_VIS_SQL} DESC, total_refs DESC, qualified LIMIT 50) GROUP BY file""")
def project_map_summary(f):
    grouped = rank.group_by_file(rank.rank_symbols(f.symbols, f.refs, 50))
    return grouped.select("file", F.size("symbols").cast("long").alias("n"), F.array_max(F.transform("symbols", lambda s: -s["col1"])).alias("best"))


@query("""SELECT file, place, qualified, kind, line, greatest(n - 20, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, id) AS place,
count(*) OVER (PARTITION BY file) AS n FROM symbols WHERE kind IN ('class', 'module', 'interface', 'record', 'union')) WHERE place <= 20""")
def project_map_full(f):
    return rank.project_map(f.symbols).withColumn("place", F.col("place").cast("long"))


@query("SELECT 'py' AS ext, count(*) AS files FROM (SELECT DISTINCT file FROM symbols)")
def extension_histogram(f):
    return rank.extension_histogram(lookup.distinct_files(f.symbols), "file")


@query("SELECT 'python' AS language, count(*) AS files FROM (SELECT DISTINCT file FROM symbols)")
def primary_language(f):
    return rank.primary_language(lookup.distinct_files(f.symbols), "file")


# --- maintenance ---------------------------------------------------------------------------------


def _tracked(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.round("o_totalprice").cast("long").alias("mtime"))
    tracked = orders.filter("o_orderkey % 3 <> 0").select("path", "mtime")
    disk = orders.filter("o_orderkey % 5 <> 0").select("path", (F.col("mtime") + (F.col("o_orderkey") % 7 == 0).cast("long")).alias("mtime"))
    return tracked, disk


@query("""SELECT coalesce(t.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'deleted' WHEN t.path IS NULL THEN 'new' ELSE 'modified' END AS reason
FROM tracked t FULL JOIN disk d ON t.path = d.path WHERE t.mtime IS DISTINCT FROM d.mtime""", facts=False)
def stale_files(spark, sf_dir):
    return incremental.stale_files(*_tracked(spark, sf_dir))


@query("SELECT file, count(*) AS n FROM symbols WHERE file NOT IN ('src/Brand_7.py', 'src/Brand_8.py') GROUP BY file")
def clear_file(f):
    files = f.symbols.sparkSession.createDataFrame([("src/Brand_7.py",), ("src/Brand_8.py",)], "path string")
    return incremental.without_files(f.symbols, files).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN file = 'src/Brand_7.py' THEN upper(name) ELSE name END AS name, file FROM symbols")
def replace_file(f):
    files = f.symbols.sparkSession.createDataFrame([("src/Brand_7.py",)], "path string")
    facts = f.symbols.select("id", "name", "file")
    fresh = facts.filter("file = 'src/Brand_7.py'").withColumn("name", F.upper("name"))
    return incremental.replace_files(facts, fresh, files)


@query(f"SELECT id, CASE WHEN qualified = {ENTRY_SQL} THEN 'unit' ELSE type_signature END AS type_signature, CASE WHEN qualified = {ENTRY_SQL} THEN 'semantic' ELSE 'syntactic' END AS source FROM symbols")
def type_update(f):
    types = f.symbols.sparkSession.createDataFrame([(_entry(f), "unit")], "qualified string, type_signature string")
    return incremental.update_types(f.symbols.withColumn("source", F.lit("syntactic")), types).select("id", "type_signature", "source")


# --- text functions ------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'feat' WHEN 2 THEN 'fix' END AS commit_type FROM orders""", facts=False)
def commit_type(spark, sf_dir):
    k = F.col("o_orderkey")
    message = F.when(k % 4 == 0, "feat(core): x").when(k % 4 == 1, "feature: y").when(k % 4 == 2, "  fix!: z").otherwise("chores")
    return read(spark, sf_dir, "orders").select(k, history.commit_type(message).alias("commit_type"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS commit, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS author,
CASE WHEN c_custkey % 2 = 0 THEN 'docs: a|b' END AS message, CASE WHEN c_custkey % 2 = 0 THEN 'docs' END AS commit_type FROM customer""", facts=False)
def log_line_parse(spark, sf_dir):
    k = F.col("c_custkey")
    hash_ = F.when(k % 2 == 0, F.lpad(k.cast("string"), 8, "0")).otherwise("nothex!")
    line = F.concat_ws("|", hash_, "c_name", F.lit("2024-01-01"), F.lit("2 days ago"), F.lit("docs: a"), F.lit("b"))
    parsed = read(spark, sf_dir, "customer").select(k, history.log_line(line).alias("p"))
    return parsed.select("c_custkey", "p.commit", "p.author", "p.message", "p.commit_type")


def _frames(name: str, shape: str, sql_symbol: str, sql_file: str, sql_line: str, user: str) -> None:
    sql = f"SELECT event_id, {sql_symbol} AS symbol, {sql_file} AS file, {sql_line} AS line, {user} AS is_user_code, '{name}' AS language FROM events WHERE event_type = 'error'"

    def run(spark, sf_dir):
        e = read(spark, sf_dir, "events").filter("event_type = 'error'")
        line = F.format_string(shape, F.col("user_id"), F.col("event_id"))
        return e.select("event_id", stack.frame(line).alias("f")).select("event_id", "f.symbol", "f.file", "f.line", "f.is_user_code", "f.language")

    run.__name__ = f"stack_frames_{name}"
    query(sql, facts=False)(run)


_frames("java", "at com.app.U%d.run(Main.java:%d)", "concat('com.app.U', user_id, '.run')", "'Main.java'", "CAST(event_id AS INT)", "true")
_frames("ruby", "app/u%d.rb:%d:in `call'", "'call'", "concat('app/u', user_id, '.rb')", "CAST(event_id AS INT)", "true")
_frames("python", 'File "/x/site-packages/u%d.py", line %d, in go', "'go'", "concat('/x/site-packages/u', user_id, '.py')", "CAST(event_id AS INT)", "false")
_frames("javascript", "at go (/app/u%d.js:%d:7)", "'go'", "concat('/app/u', user_id, '.js')", "CAST(event_id AS INT)", "true")
_frames("rust", "%d: app::u%d::go", "concat('app::u', event_id, '::go')", "NULL::VARCHAR", "NULL::INT", "true")
_frames("go", "/app/u%d.go:%d +0x1d", "'<location>'", "concat('/app/u', user_id, '.go')", "CAST(event_id AS INT)", "true")


@query(_CONTAINED_SQL + _CALLERS_SQL + """, frames AS (SELECT event_id AS trace_id, s.qualified AS symbol FROM events e JOIN symbols s ON s.id = e.event_id % (SELECT count(*) FROM part) WHERE event_type = 'error'),
called AS (SELECT target, count(DISTINCT container) AS callers FROM pairs WHERE container <> target GROUP BY target)
SELECT trace_id, symbol, symbol AS defined_as, coalesce(c.callers, 0) AS callers FROM frames LEFT JOIN called c ON c.target = symbol""", facts=False)
def analyze_stacktrace(spark, sf_dir):
    """The trace of every error event; events take turns at the symbols that they name."""
    f = star_facts(spark, sf_dir)
    parts = f.symbols.agg(F.count("*").alias("parts_"))
    e = read(spark, sf_dir, "events").filter("event_type = 'error'").join(F.broadcast(parts), F.lit(True)).withColumn("id", F.col("event_id") % F.col("parts_"))
    traces = e.join(shuffled(f.symbols.select("id", "qualified")), "id").select(F.col("event_id").alias("trace_id"), F.concat(F.lit("Error: x\nat "), "qualified", F.lit("(Main.java:3)")).alias("text"))
    frames = stack.parse_traces(traces).filter("frame is not null").select("trace_id", "frame.symbol")
    return graph.analyse_frames(frames, f.symbols, f.refs).select("trace_id", "symbol", "defined_as", "callers")


@query("SELECT id, split_part(qualified, '.', 1) AS simple FROM symbols WHERE type_signature IS NOT NULL")
def simple_type_name(f):
    return f.symbols.filter("type_signature is not null").select("id", text.simple_type_name(F.col("type_signature")).alias("simple"))


@query(f"SELECT id, {_KIND_SQL} AS weight, split_part(qualified, '.', 1) || '.' || split_part(qualified, '.', 2) AS module FROM symbols")
def symbol_codes(f):
    return f.symbols.select("id", text.kind_weight(F.col("kind")).alias("weight"), text.module_prefix(F.col("qualified")).alias("module"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'open A' || chr(10) || 'open Z' || chr(10) || 'open A.B' END AS organised, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END AS line FROM orders""", facts=False)
def organize_opens(spark, sf_dir):
    k = F.col("o_orderkey")
    content = F.when(k % 3 == 0, "module M\nopen Z\nopen A.B\nopen A\nlet x = 1").when(k % 3 == 1, "module M\nlet x = 1").otherwise("let x = 1")
    return read(spark, sf_dir, "orders").select(k, editor.organised_opens(content).alias("organised"), editor.open_insert_line(content).alias("line"))


@query("""SELECT name AS label, CASE WHEN NOT (EXISTS (SELECT 1 FROM opens o WHERE o.file = 'src/Brand_7.py' AND o.module_path = split_part(qualified, '.', 1) || '.' || split_part(qualified, '.', 2))
OR ends_with(split_part(qualified, '.', 2), 'Brand_7')) THEN qualified END AS insert_text, id FROM symbols
WHERE starts_with(lower(name), 'hot') OR contains(lower(qualified), 'hot') ORDER BY starts_with(lower(name), 'hot') DESC, strlen(name), qualified, id LIMIT 50""")
def completion_symbols(f):
    return editor.symbol_completions(f.symbols, f.opens, "src/Brand_7.py", "hot").select("label", "insert_text", "id")


@query("""SELECT name AS label, id FROM symbols WHERE file = 'src/Brand_7.py' OR qualified IN (SELECT qualified FROM symbols WHERE file = 'src/Brand_7.py')
OR split_part(qualified, '.', 1) || '.' || split_part(qualified, '.', 2) IN (SELECT module_path FROM opens WHERE file = 'src/Brand_7.py') ORDER BY id LIMIT 40""")
def completion_scope(f):
    symbols = f.symbols.drop("implements")
    return editor.symbol_completions(symbols, f.opens, "src/Brand_7.py", "", 40).select("label", "id").distinct()


@query("SELECT member_name AS label, kind, member_type AS detail FROM members WHERE type_name = 'SMALL'")
def completion_members(f):
    return editor.member_completions(f.members, "SMALL")


@query("SELECT 'symbols' AS \"check\", true AS ok, CAST(count(*) AS VARCHAR) AS detail FROM symbols UNION ALL SELECT 'files', true, CAST(count(DISTINCT file) AS VARCHAR) FROM symbols UNION ALL SELECT 'languages', true, count(DISTINCT file) || ' of ' || count(DISTINCT file) FROM symbols")
def doctor(f):
    return editor.health(f.symbols, lookup.distinct_files(f.symbols).select(F.col("file").alias("path")))


# --- events --------------------------------------------------------------------------------------

_MOVES_SQL = """, moves AS (SELECT ts, seq, 0 AS part, CASE WHEN op IN ('Deleted', 'Renamed') THEN 'delete' ELSE 'update' END AS action, path FROM watch_events
UNION ALL SELECT ts, seq, 1, 'update', new_path FROM watch_events WHERE op = 'Renamed')"""


@query(_MOVES_SQL + " SELECT path, arg_max(action, seq * 2 + part) AS action FROM moves GROUP BY path", facts=False)
def event_coalesce(spark, sf_dir):
    return watch.coalesced(watch_events(spark, sf_dir))


@query(_MOVES_SQL + " SELECT date_trunc('hour', ts) AS hour, path, arg_max(action, seq * 2 + part) AS action, count(*) AS events FROM moves GROUP BY 1, 2", facts=False)
def event_tumbling(spark, sf_dir):
    out = watch.windowed(watch_events(spark, sf_dir), "1 hour")
    return out.select(F.col("w.start").alias("hour"), "path", "action", "events")


@query(None, facts=False)
def rate_limit(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("seq"))
    return watch.rate_limited(e, limit=2, seconds=36_000.0)

"""Queries over text functions, editor answers, source lines, external types and watch notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import stack, text
from .operators import editor, graph, incremental, lookup, rank, refs, search
from .plans.adapters import read
from .registry import ENTRY_SQL, query
from .sources import projects
from .streaming import watch

_LAST = "split_part(qualified, '.', 3)"


@query("SELECT id, '/work/' || file AS absolute, file AS relative, '/other/' || file AS outside, 'a/b/' || name AS slashed, 'src/' || name || '.py' AS normal FROM symbols")
def path_forms(f):
    """Absolute and relative paths, Windows separators, and paths without detours."""
    file, absolute = F.col("file"), text.absolute_path(F.col("file"), "/work/")
    return f.symbols.select(
        "id", absolute.alias("absolute"), text.relative_path(absolute, "/work").alias("relative"), text.relative_path(F.concat(F.lit("/other/"), file), "/work").alias("outside"),
        text.normalise_windows_path(F.concat(F.lit("a\\b\\"), "name")).alias("slashed"), text.normalise_path(F.concat(F.lit("src/./x//../"), "name", F.lit(".py"))).alias("normal"),
    )


@query("""SELECT id, kind AS encoded, CASE WHEN id % 7 = 0 THEN 'value' ELSE kind END AS decoded, upper(kind[1]) || kind[2:] AS shown,
CASE kind WHEN 'module' THEN 2 WHEN 'function' THEN 12 WHEN 'value' THEN 13 WHEN 'type' THEN 5 WHEN 'record' THEN 23 WHEN 'union' THEN 10 WHEN 'interface' THEN 11 WHEN 'class' THEN 5 ELSE 6 END AS number FROM symbols""")
def kind_codes(f):
    """Kinds as they are stored, read, shown and numbered; what is unknown counts as a value."""
    odd = F.when(F.col("id") % 7 == 0, "trait").otherwise(F.col("kind"))
    return f.symbols.select("id", text.encode_kind(F.initcap("kind")).alias("encoded"), text.decode_kind(odd).alias("decoded"), text.display_kind(F.col("kind")).alias("shown"), text.editor_kind(F.col("kind")).alias("number"))


@query("""SELECT m.id, visibility AS encoded, CASE WHEN m.id % 5 = 0 THEN 'public' ELSE visibility END AS decoded, m.kind AS member_encoded,
CASE WHEN m.id % 5 = 0 THEN 'property' ELSE m.kind END AS member_decoded FROM members m JOIN symbols s ON s.id = m.id""")
def visibility_codes(f):
    both = f.members.select("id", F.col("kind").alias("member")).join(f.symbols.select("id", "visibility"), "id")
    odd = lambda c: F.when(F.col("id") % 5 == 0, "odd").otherwise(F.col(c))
    return both.select("id", text.encode_visibility(F.upper("visibility")).alias("encoded"), text.decode_visibility(odd("visibility")).alias("decoded"), text.encode_member_kind(F.initcap("member")).alias("member_encoded"), text.decode_member_kind(odd("member")).alias("member_decoded"))


@query(f"""SELECT id, {_LAST} AS word, split_part(qualified, '.', 1) || '.' || split_part(qualified, '.', 2) AS expression, false AS plain_interface, true AS interface,
CASE WHEN id % 2 = 0 THEN 'public' ELSE 'private' END AS exported FROM symbols""")
def word_forms(f):
    """The word and the expression before the cursor, interface names, and names that Go exports."""
    line = F.concat(F.lit("let x = f ("), "qualified")
    cased = F.when(F.col("id") % 2 == 0, F.initcap("name")).otherwise(F.lower("name"))
    return f.symbols.select("id", text.word_before(line).alias("word"), text.expression_before_dot(line).alias("expression"), text.is_interface_name(F.col("name")).alias("plain_interface"), text.is_interface_name(F.concat(F.lit("I"), F.initcap("name"))).alias("interface"), text.exported_name(cased).alias("exported"))


# --- source lines ----------------------------------------------------------------------------------

_LINES = 400


def _sources(f):
    """A text of numbered rows for each file."""
    rows = F.transform(F.sequence(F.lit(1), F.lit(_LINES)), lambda i: F.concat(F.lit("row "), i.cast("string")))
    return f.symbols.select(F.col("file").alias("path")).distinct().withColumn("content", F.array_join(rows, "\n"))


@query(f"""SELECT name, file, line, col AS "column", CASE WHEN line <= {_LINES} THEN 'row ' || line END AS context FROM refs""")
def lines_of_refs(f):
    """The line of every ref; null beyond the end of the file."""
    return refs.with_lines(f.refs, _sources(f)).select("name", "file", "line", "column", "context")


@query(f"""SELECT name, file, line, col AS "column", CASE WHEN line <= {_LINES} THEN array_to_string(list_transform(range(greatest(line - 2, 1), least(line + 3, {_LINES + 1})), lambda i: printf('%4d', i) || ' | row ' || i), chr(10)) END AS context
FROM refs WHERE file = 'src/Brand_7.py'""")
def context_of_refs(f):
    """The numbered lines around every ref of a file."""
    return refs.with_lines(f.refs.filter("file = 'src/Brand_7.py'"), _sources(f), 2, True).select("name", "file", "line", "column", "context")


@query(f"""SELECT name, file, line, col AS "column", CASE WHEN file = 'src/Brand_8.py' AND line <= {_LINES} THEN 'row ' || line END AS context FROM refs WHERE file IN ('src/Brand_7.py', 'src/Brand_8.py')""")
def lines_within_root(f):
    """The lines of refs, of files under a root only; detours in a path do not lead out of it."""
    path = F.when(F.col("path") == "src/Brand_8.py", "/work/src/./Brand_8.py").otherwise(F.concat(F.lit("/work/../"), "path"))
    sources = _sources(f).withColumns({"path": path, "key": F.col("path")})
    found = f.refs.filter("file in ('src/Brand_7.py', 'src/Brand_8.py')")
    shown = refs.with_lines(found.withColumns({"key": F.col("file"), "file": F.when(F.col("file") == "src/Brand_8.py", "/work/src/./Brand_8.py").otherwise(F.concat(F.lit("/work/../"), "file"))}), sources.drop("key"), root="/work")
    return shown.select("name", F.col("key").alias("file"), "line", "column", "context")


# --- editor ----------------------------------------------------------------------------------------


@query(f"SELECT qualified, type_signature AS text FROM symbols WHERE id = 0 AND qualified = {ENTRY_SQL}")
def hover_text(f):
    entry = f.symbols.filter("id = 0").first()["qualified"]
    return editor.hover(f.symbols.withColumn("signature", F.lit(None).cast("string")), entry)


@query("SELECT qualified, 'f ' || name AS signature, CASE WHEN id % 2 = 0 THEN 'Does ' || name || '.' END AS doc FROM symbols WHERE id = (SELECT min(id) FROM symbols WHERE name = 'hot_gear')")
def documentation_searched(f):
    """The doc of a symbol asked for by its short name."""
    own = f.symbols.withColumns({"signature": F.concat(F.lit("f "), "name"), "doc": F.when(F.col("id") % 2 == 0, F.concat(F.lit("Does "), "name", F.lit(".")))})
    return editor.documentation(own, "hot_gear")


@query("SELECT unnest(['module', 'match', 'match!', 'mutable', 'member']) AS label")
def keywords_with_m(f):
    return editor.keyword_completions(f.symbols.sparkSession, "m")


@query("SELECT file, 'error' AS severity, name AS message, line FROM symbols WHERE file = 'src/Brand_7.py' AND id % 3 = 0")
def diagnostics_of_file(f):
    found = f.symbols.select("file", F.when(F.col("id") % 3 == 0, "error").otherwise("warning").alias("severity"), F.col("name").alias("message"), "line")
    return editor.diagnostics_of(found, "src/Brand_7.py")


@query("SELECT id, qualified FROM symbols WHERE file = (SELECT file FROM symbols WHERE id = 5) AND line = 6")
def symbol_at_line(f):
    file = f.symbols.filter("id = 5").first()["file"]
    return editor.definition_at(f.symbols, file, 6).select("id", "qualified")


@query("SELECT id, qualified, CASE id % 3 WHEN 0 THEN 'int -> ' || name WHEN 1 THEN 'Does ' || name || '.' ELSE kind || ' ' || name END AS text FROM symbols")
def item_texts(f):
    """The text of an item: its signature, else the first line of its doc, else kind and name."""
    own = f.symbols.withColumns({"signature": F.when(F.col("id") % 3 == 0, F.concat(F.lit("int -> "), "name")), "doc": F.when(F.col("id") % 3 == 1, F.concat(F.lit("Does "), "name", F.lit(".\nAt length.")))})
    return editor.item_text(own)


@query("SELECT id, file || ':' || line || ':' || col AS location FROM symbols")
def locations(f):
    return search.location_text(f.symbols)


@query("""SELECT id, qualified, least(levenshtein('hot_gaer', name), levenshtein('hot_gaer', qualified)) AS distance FROM symbols
WHERE language = 'promo' AND least(levenshtein('hot_gaer', name), levenshtein('hot_gaer', qualified)) <= 3 ORDER BY distance, id LIMIT 20""")
def symbols_spelt_alike(f):
    """Symbols listed by what is spelt alike, in one language."""
    return search.find_symbols(f.symbols, "hot_gaer", 20, "promo", fuzzy=True).select("id", "qualified", F.col("distance").cast("long").alias("distance"))


@query("SELECT asked, qualified, how FROM (SELECT 'hot_gaer' AS asked, value AS qualified, 'suggested' AS how, levenshtein('hot_gaer', value) AS d FROM (SELECT name AS value FROM symbols UNION SELECT qualified FROM symbols) WHERE levenshtein('hot_gaer', value) BETWEEN 1 AND 3 ORDER BY d, value LIMIT 5)")
def callers_suggested(f):
    """Callers asked for by a name that nothing has: near names instead."""
    return graph.find_callers(f.symbols, f.refs, "hot_gaer")


@query("SELECT simple AS type_name FROM (SELECT split_part(qualified, '.', 1) AS simple, qualified FROM symbols WHERE name = 'hot_gear' AND type_signature IS NOT NULL ORDER BY qualified LIMIT 1)")
def type_of_expression(f):
    """The type that the members of an expression are looked up by."""
    types = f.symbols.filter("type_signature is not null").select("qualified", "name", "type_signature")
    return projects.expression_type(types, f.members, "hot_gear")


@query("SELECT ord, file AS path FROM (SELECT file, row_number() OVER (ORDER BY file) - 1 AS ord FROM (SELECT DISTINCT file FROM symbols WHERE file <> 'src/Brand_7.py'))")
def project_compile_order(f):
    """The compile order of a project file that lists the sources (twice), and other items."""
    files = [r["file"] for r in lookup.distinct_files(f.symbols).filter("file <> 'src/Brand_7.py'").collect()]  # the files of one project
    items = "".join(f'<Compile Include="{p.replace("/", chr(92))}" />' for p in sorted(files) * 2)
    xml = f'<Project><PropertyGroup><Compile Include="no.fs" /></PropertyGroup><ItemGroup>{items}<PackageReference Include="P" Version="1" /></ItemGroup></Project>'
    found = list(dict.fromkeys(projects.parse_fsproj(xml, "")["compile"]))
    return f.symbols.sparkSession.createDataFrame(list(enumerate(found)), "ord long, path string")


# --- external types --------------------------------------------------------------------------------


@query("SELECT 'Console' AS name, 'System.Console' AS qualified, 'class' AS kind, 'System.Console' AS assembly")
def external_exact(f):
    return projects.external_exact(projects.external_symbols(f.symbols.sparkSession), "System.Console")


@query("SELECT unnest(['System.Console', 'System.Console.WriteLine', 'System.Console.Write', 'System.Console.ReadLine', 'System.Console.ReadKey', 'System.Console.Clear']) AS qualified")
def external_search(f):
    return projects.search_external(projects.external_symbols(f.symbols.sparkSession), "Console").select("qualified")


@query("""SELECT unnest(['Regex', 'Match', 'Matches', 'Replace', 'IsMatch']) AS name, unnest(['class', 'function', 'function', 'function', 'function']) AS kind""")
def external_assembly(f):
    return projects.external_in(projects.external_symbols(f.symbols.sparkSession), "System.Text.RegularExpressions").select("name", "kind")


# --- watching --------------------------------------------------------------------------------------


@query("""SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS op, 'src/u' || user_id || CASE user_id % 3 WHEN 0 THEN '.py' ELSE '.rs' END AS path
FROM events WHERE event_type <> 'view' AND user_id % 3 <> 2""", facts=False)
def notices_decoded(spark, sf_dir):
    """Raw notices of a watcher as events: other kinds of change and other files go."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "create/file").when(F.col("event_type") == "error", "remove/file").when(F.col("event_type") == "view", "modify/metadata/any").when(F.col("event_type") == "click", "modify/data/content").otherwise("modify")
    ending = F.when(F.col("user_id") % 3 == 0, ".py").when(F.col("user_id") % 3 == 1, ".rs").otherwise(".PY")
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), ending)
    return watch.meaningful(e.select("ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.array(F.lit("x.tmp"), path).alias("paths"))).select("seq", "op", "path")


@query("""SELECT path, action FROM (SELECT path, arg_max(action, seq * 2 + part) AS action FROM (SELECT seq, 0 AS part, CASE WHEN op IN ('Deleted', 'Renamed') THEN 'delete' ELSE 'update' END AS action, path FROM watch_events
UNION ALL SELECT seq, 1, 'update', new_path FROM watch_events WHERE op = 'Renamed') GROUP BY path) WHERE action = 'delete'""", facts=False)
def deletions_pending(spark, sf_dir):
    """What a flush of the batch would delete."""
    from .plans.adapters import watch_events

    return watch.coalesced(watch_events(spark, sf_dir)).filter("action = 'delete'")


@query("""SELECT event_id, 'app/u' || user_id || '.rb' AS file FROM events WHERE event_type = 'error' AND user_id % 2 = 0""", facts=False)
def user_frames(spark, sf_dir):
    """Frames of the user's own code only."""
    e = read(spark, sf_dir, "events").filter("event_type = 'error'")
    home = F.when(F.col("user_id") % 2 == 0, "app").otherwise("/usr/lib/ruby/gems/x")
    line = F.concat(home, F.lit("/u"), F.col("user_id").cast("string"), F.lit(".rb:7:in `call'"))
    return e.select("event_id", stack.frame(line).alias("f")).filter("f.is_user_code").select("event_id", "f.file")


@query("SELECT 'f' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS mtime FROM orders WHERE o_orderkey % 3 <> 0 AND floor(o_totalprice) > 200000", facts=False)
def changed_since(spark, sf_dir):
    """Files that changed after a time."""
    orders = read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0")
    files = orders.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.floor("o_totalprice").cast("long").alias("mtime"))
    return incremental.is_stale(files, 200_000)


@query("SELECT language, count(*) AS files FROM (SELECT CASE CAST(regexp_extract(file, '_([0-9]+)', 1) AS INT) % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'cpp' ELSE 'typescript' END AS language FROM (SELECT DISTINCT file FROM symbols)) GROUP BY 1 ORDER BY files DESC, language LIMIT 1")
def primary_language_mixed(f):
    """The language that most of a project's files are in, where they differ."""
    n = F.regexp_extract("file", r"_(\d+)", 1).cast("int") % 3
    files = lookup.distinct_files(f.symbols).select(F.concat("file", F.when(n == 0, ".rs").when(n == 1, ".hpp").otherwise(".tsx")).alias("path"))
    return rank.primary_language(files)

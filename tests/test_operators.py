"""Operators on small literal tables, and graph walks against plain Python."""

import random
from collections import deque

from pyspark.sql import functions as F

from symtrail.functions import history, stack, text
from symtrail.operators import graph, incremental, lookup, rank, refs, resolve, search
from symtrail.streaming import watch

SYMBOLS = "id long, name string, qualified string, kind string, file string, line int, column int, visibility string, language string, parent string, implements array<string>"
REFS = "id long, name string, file string, line int, column int"


def symbols(spark, *rows):
    return spark.createDataFrame([(i, n, q, k, f, ln, 1, "public", "fsharp", None, None) for i, (n, q, k, f, ln) in enumerate(rows)], SYMBOLS)


def reflist(spark, *rows):
    return spark.createDataFrame([(i, n, f, ln, 1) for i, (n, f, ln) in enumerate(rows)], REFS)


def names(df, column="qualified"):
    return sorted(r[column] for r in df.collect())


def test_pattern_search_is_ascii_case_blind_and_keeps_wildcards(spark):
    s = symbols(spark, ("PayService", "A.PayService", "class", "a", 1), ("pay_x", "A.pay_x", "value", "a", 2), ("payÉ", "A.payÉ", "value", "a", 3), ("a~b", "A.a~b", "value", "a", 4))
    assert names(search.search(s, "pay*", 9)) == ["A.PayService", "A.pay_x", "A.payÉ"]
    assert names(search.search(s, "pay_x", 9)) == ["A.pay_x"]
    assert names(search.search(s, "*é", 9)) == []
    assert names(search.search(s, "*a~b", 9)) == ["A.a~b"]
    assert names(search.search_text(s, "pay", 9)) == ["A.PayService", "A.payÉ", "A.pay_x"] or len(names(search.search_text(s, "pay", 9))) == 3


def test_first_and_last_overload(spark):
    s = symbols(spark, ("f", "M.f", "function", "a", 1), ("f", "M.f", "function", "b", 2))
    assert lookup.find_first(s, "M.f").first()["file"] == "a"
    assert lookup.get_last(s, "M.f").first()["file"] == "b"
    assert len(names(lookup.symbols_in_file_indexed(s, "a"))) == 2


def test_references_by_suffix(spark):
    r = reflist(spark, ("User", "a", 1), ("M.User", "a", 2), ("X\\User", "a", 3), ("SuperUser", "a", 4), ("m::user", "a", 5))
    assert names(refs.find_references(r, "User"), "name") == ["M.User", "User", "X\\User", "m::user"]


def test_containing_symbol_is_the_last_callable_before(spark):
    s = symbols(spark, ("helper", "helper", "function", "utils.c", 10), ("processCommand", "processCommand", "function", "main.c", 100), ("x", "x", "value", "main.c", 101), ("y", "y", "value", "main.c", 102))
    r = reflist(spark, ("helper", "main.c", 105), ("helper", "main.c", 5))
    got = {x["line"]: x["container"] for x in refs.containing_symbol(s, r).collect()}
    assert got == {105: "processCommand", 5: None}
    assert names(graph.callers(s, r, "helper")) == ["processCommand"]


def test_walks_equal_plain_python(spark):
    rng = random.Random(3)
    nodes = [f"N{i}" for i in range(40)]
    s = symbols(spark, *[(n, f"M.{n}", "function", f"f{i}", 1) for i, n in enumerate(nodes)])
    edges = [(f"M.{rng.choice(nodes)}", f"f{i}", 2) for i in range(40) for _ in range(rng.randrange(3))]
    r = reflist(spark, *edges)
    opens = spark.createDataFrame([], "file string, module_path string, ord int")

    def plain(start, depth, forward):
        seen, todo = {start: 0}, deque([start])
        while todo:
            at = todo.popleft()
            if seen[at] == depth:
                continue
            out = [n for n, f, _ in edges if f == "f" + at[3:]] if forward else ["M.N" + f[1:] for n, f, _ in edges if n == at]
            for n in out:
                if n not in seen:
                    seen[n] = seen[at] + 1
                    todo.append(n)
        return seen

    ahead = {x["qualified"]: x["depth"] for x in graph.spider(s, r, opens, "M.N0", 3).collect()}
    assert ahead == plain("M.N0", 3, True)
    target = edges[0][0]
    back = {x["qualified"]: x["depth"] for x in graph.reverse_spider(s, r, target, 3).collect()}
    assert back == plain(target, 3, False)
    assert graph.spider(s, r, opens, "nowhere", 3).count() == 0


def test_resolution_order_and_leftovers(spark):
    s = symbols(spark, ("go", "A.go", "function", "a", 1), ("go", "B.go", "function", "b", 1), ("helper", "C.helperX", "function", "c", 1))
    r = reflist(spark, ("go", "z", 1), ("A.go", "z", 2), ("helper", "z", 3), ("none", "z", 4))
    opens = spark.createDataFrame([("z", "B", 1), ("z", "A", 2)], "file string, module_path string, ord int")
    got = {x["name"]: x["target"] for x in graph.resolve_refs(s, opens, r).collect()}
    assert got == {"go": "B.go", "A.go": "A.go", "helper": "C.helperX", "none": None}
    order = spark.createDataFrame([("a", 0), ("z", 1), ("b", 2)], "path string, ord int")
    seen = {x["name"]: x["target"] for x in graph.resolve_refs(s, opens, r, order).collect()}
    assert seen["go"] == "A.go"  # B comes later in the compile order


def test_language_rules(spark):
    s = symbols(spark, ("App", "App", "module", "a.rb", 1), ("User", "App::User", "class", "b.rb", 1), ("run", "App::User::run", "function", "b.rb", 2))
    opens = spark.createDataFrame([], "file string, module_path string, ord int")
    wanted = spark.createDataFrame([("User", "a.rb"), ("App::User", "z.rb"), ("run", "b.rb"), ("User", "z.rb")], "name string, from_file string")
    got = {(x["name"], x["from_file"]): x["qualified"] for x in resolve.resolve(wanted, s, opens, "ruby").collect()}
    assert got == {("User", "a.rb"): "App::User", ("App::User", "z.rb"): "App::User", ("run", "b.rb"): "App::User::run"}
    dotted = spark.createDataFrame([("User::run", "a.rb")], "name string, from_file string")
    assert resolve.resolve_dotted(dotted, s, opens, "ruby").first()["qualified"] == "App::User::run"
    f = symbols(spark, ("x", "A.B.x", "value", "a.fs", 1), ("y", "A.y", "value", "b.fs", 1))
    up = spark.createDataFrame([("y", "a.fs")], "name string, from_file string")
    assert resolve.resolve(up, f, opens, "fsharp").first()["qualified"] == "A.y"
    for language in resolve.RULES:
        assert resolve.resolve(wanted, s, opens, language).count() >= 1


def test_ranking_counts_an_overload_twice(spark):
    s = symbols(spark, ("a", "M.a", "function", "f1", 1), ("b", "M.b", "class", "f1", 2), ("b", "M.b", "class", "f2", 2))
    r = reflist(spark, ("a", "f1", 1), ("M.a", "f2", 1), ("b", "f1", 1))
    got = {x["qualified"]: (x["file_diversity"], x["total_refs"]) for x in rank.rank_symbols(s, r, 5).collect()}
    assert got == {"M.a": (2, 2), "M.b": (1, 2)}
    assert rank.describe(s, r, "anything").count() == 2


def test_fuzzy_and_suggestions(spark):
    s = symbols(spark, ("kitten", "kitten", "value", "a", 1), ("sitting", "sitting", "value", "a", 2), ("é", "é", "value", "a", 3))
    assert [(x["name"], x["distance"]) for x in search.fuzzy_search(s, "kitten", 3, 5).collect()] == [("kitten", 0), ("sitting", 3)]
    assert names(search.suggest_similar(s, "kitten"), "value") == ["sitting"]
    assert names(search.suggest_similar(s, "e", 1), "value") == ["é"]


def test_stale_files(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mtime long")
    d = spark.createDataFrame([("b", 1), ("c", 3), ("d", 9)], "path string, mtime long")
    assert {tuple(x) for x in incremental.stale_files(t, d).collect()} == {("a", "deleted"), ("b", "modified"), ("d", "new")}


def test_stack_traces(spark):
    trace = "\n".join([
        "Exception: boom", "at com.acme.Main.run(Main.java:12)", "at java.lang.Thread.run(Unknown Source)", "", "from /app/x.rb:3:in `call'",
        '  File "/app/y.py", line 4, in go', '  File "/usr/lib/python3/z.py", line 5', "at fn (/app/z.js:1:2)", "at /app/node_modules/q.js:9:1",
        "  3: app::main", "at src/main.rs:4:5", "main.handler(0x1)", "/app/m.go:7 +0x1d", "garbage",
    ])
    df = spark.createDataFrame([(1, trace)], "trace_id long, text string")
    got = [(x["frame"] and tuple(x["frame"]), x["detected_language"]) for x in stack.parse_traces(df).orderBy("line_no").collect()]
    frames = [g[0] for g in got]
    assert frames == [
        ("com.acme.Main.run", "Main.java", 12, None, True, "java"), ("java.lang.Thread.run", None, None, None, False, "java"),
        ("call", "/app/x.rb", 3, None, True, "ruby"), ("go", "/app/y.py", 4, None, True, "python"), ("<module>", "/usr/lib/python3/z.py", 5, None, False, "python"),
        ("fn", "/app/z.js", 1, 2, True, "javascript"), ("<anonymous>", "/app/node_modules/q.js", 9, 1, False, "javascript"),
        ("app::main", None, None, None, True, "rust"), ("<location>", "src/main.rs", 4, 5, True, "rust"),
        ("main.handler", None, None, None, True, "go"), ("<location>", "/app/m.go", 7, None, True, "go"), None,
    ]
    assert {g[1] for g in got} == {"java"}


def test_history_text(spark):
    df = spark.createDataFrame([("abc1234|Ann|2024-01-01|2 days ago|feat(x): a|b",), ("xyz|a|b|c|d",), ("abc1234|a|b",)], "line string")
    got = [x[0] for x in df.select(history.log_line(F.col("line"))).collect()]
    assert got[0]["message"] == "feat(x): a|b" and got[0]["commit_type"] == "feat" and got[1] is None and got[2] is None


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.simple_type_name(F.lit("int -> User list"))) == "User"
    assert one(text.simple_type_name(F.lit("Result<User, string>"))) == "User"
    assert one(text.module_prefix(F.lit("A.B.c"))) == "A.B" and one(text.module_prefix(F.lit("c"))) is None
    assert one(text.normalise_path(F.lit("a/./b//../c"))) == "a/c"
    assert one(text.word_before(F.lit("let x = fooBar"))) == "fooBar"
    assert one(text.expression_before_dot(F.lit("x = user.na"))) == "user"
    assert one(text.decode_kind(F.lit("nonsense"))) == "value"


def test_events_coalesce_and_limit(spark):
    rows = [(1, "Modified", "a", None), (2, "Deleted", "a", None), (3, "Renamed", "b", "c"), (4, "Created", "d", None), (5, "Modified", "d", None)]
    df = spark.createDataFrame(rows, "seq long, op string, path string, new_path string").withColumn("ts", F.timestamp_seconds("seq"))
    assert {tuple(x) for x in watch.coalesced(df).select("path", "action").collect()} == {("a", "delete"), ("b", "delete"), ("c", "update"), ("d", "update")}
    r = spark.createDataFrame([("x", i, t) for i, t in enumerate([0.0, 0.1, 0.2, 1.05, 1.15])], "client string, seq long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = {x["seq"]: x["allowed"] for x in watch.rate_limited(r, 2, 1.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_missing_opens_and_rename(spark):
    s = symbols(spark, ("go", "A.go", "function", "a", 1))
    r = reflist(spark, ("go", "z", 1), ("A.go", "y", 2))
    opens = spark.createDataFrame([], "file string, module_path string, ord int")
    assert names(graph.missing_opens(s, opens, r, "z"), "module") == ["A"]
    plan = {(x["file"], x["new_text"]) for x in graph.rename_plan(s, r, "A.go", "run").collect()}
    assert plan == {("a", "run"), ("z", "run"), ("y", "A.run")}

"""What plans make and send on the way to a result, by the counts of the rows of their nodes."""

from collections import defaultdict

from pyspark.sql import functions as F

from symtrail.operators import graph, refs

SYMBOLS = "id long, name string, qualified string, kind string, file string, line int"
REFS = "id long, name string, file string, line int, column int"


def most_rows(spark, run, node=""):
    """The most rows that one node of a plan gives out while run() goes on, of nodes so named."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, done = 0, store.executionsList()
    for i in range(before, done.size()):
        at = done.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            own = nodes.apply(j)
            metrics = own.metrics()
            for k in range(metrics.size()):
                m = metrics.apply(k)
                if m.name() == "number of output rows" and own.name().startswith(node) and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_namesakes_are_counted_once(spark):
    n = 150
    s = [(i, "run", f"M{i}.run", "function", "a", 10 * i + 1) for i in range(n)] + [(n + i, "call", f"A::C{i}::call", "function", "b", 10 * i + 1) for i in range(n)]
    names = ["run", "call", "x.run", "M3.run", "A::C5::call", "A::C5::call", "B.A::C5::call", "other"]
    r = [(i, names[i % len(names)], "ab"[i % 2], 10 * (i % n) + 2, 1) for i in range(n * len(names))] + [(-1, "run", "a", 10 * i + 3, 1) for i in range(n)]
    symbols, found = spark.createDataFrame(s, SYMBOLS).repartition(2), spark.createDataFrame(r, REFS)
    frames = symbols.select(F.col("qualified").alias("symbol"))
    got = {}
    most = most_rows(spark, lambda: got.update({x["symbol"]: x["callers"] for x in graph.analyse_frames(frames, symbols, found).collect()}))

    held = defaultdict(set)
    for x in refs.containing_symbol(symbols, found).collect():
        for _, name, qualified, *_ in s:
            wholes = {name, qualified, *(qualified.split(".", k)[-1] for k in range(1, qualified.count(".") + 1))}
            if x["name"] in wholes or x["name"].endswith("." + name):
                held[qualified].add(x["container"])
    assert got == {q: len(held[q] - {None, q}) for _, _, q, *_ in s}
    assert got["M0.run"] >= n - 1 and got["A::C5::call"] > got["A::C6::call"]
    assert most < n * n  # a row for each of its callers and each namesake would be more


def chain(spark, n):
    """n symbols of each of three files; the first refers to all of the second, that to all of the third."""
    files = ["a", "b", "c"]
    s = [(n * k + i, f"{f}{i}", f"{f}.{f}{i}", "function", f, i + 1) for k, f in enumerate(files) for i in range(n)]
    r = [(n * k + i, f"{files[k + 1]}.{files[k + 1]}{i}", files[k], i + 1, 1) for k in (0, 1) for i in range(n)]
    return s, r, spark.createDataFrame([], "file string, module_path string, ord int")


def test_walks_do_not_go_through_the_driver(spark):
    n = 3000
    s, r, opens = chain(spark, n)
    symbols, found = spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(r, REFS)
    got = {}
    sent = most_rows(spark, lambda: got.update({x["qualified"]: x["depth"] for x in graph.spider(symbols, found, opens, "a.a7", 2).collect()}), "BroadcastExchange")
    assert got == {"a.a7": 0} | {f"b.b{i}": 1 for i in range(n)} | {f"c.c{i}": 2 for i in range(n)}
    assert sent < 100


def test_derived_refs_do_not_send_parts_through_the_driver(spark):
    from symtrail.plans.adapters import star_facts

    assert "BroadcastHashJoin" not in star_facts(spark, "/root/testdata/sf0.001").refs._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_one_file_are_walked_together(spark):
    n = 150
    s, r, opens = chain(spark, n)
    s += [(10_000, "a3", "a.a3", "function", "d", 1), (10_001, "e", "e.e", "function", "e", 1)]  # the last overload of a.a3 is elsewhere
    r += [(10_000 + i, name, "d", 1, 1) for i, name in enumerate(["a.a0", "a.a3", "c.c1", "e.e"])] + [(10_009, "a.a9", "c", 1, 1)]
    symbols, found = spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(r, REFS)
    got = {}
    for file, depth in (("a", 2), ("d", 3), ("a", 0)):
        most = most_rows(spark, lambda: got.update({(file, depth): {x["qualified"]: x["depth"] for x in graph.spider_from_file(symbols, found, opens, file, depth).collect()}}))
        assert most < n * n

    home = {q: f for _, _, q, _, f, _ in s}
    ahead = defaultdict(set)
    for _, name, f, *_ in r:
        ahead[f].add(name)
    for (file, depth), answer in got.items():
        want = {}
        for root in dict.fromkeys(q for _, _, q, _, f, _ in s if f == file):
            seen, level = {root: 0}, {root}
            for d in range(1, depth + 1):
                level = {x for q in level for x in ahead[home[q]]} - seen.keys()
                seen |= dict.fromkeys(level, d)
            want = seen | want
        assert answer == want


def test_enriching_does_not_go_through_the_driver(spark):
    n = 3000
    s, r, opens = chain(spark, n)
    symbols, found = spark.createDataFrame(s, SYMBOLS), spark.createDataFrame([*r, *((9 * n + i, "a7", "c", i + 1, 1) for i in range(n))], REFS)
    rows = []
    sent = most_rows(spark, lambda: rows.extend(graph.enrich(symbols, found, opens, "a.a7").collect()), "BroadcastExchange")
    assert [tuple(x) for x in rows] == [("a.a7", "function", "a", 8, sorted(f"c.c{i}" for i in range(n)), sorted(f"b.b{i}" for i in range(n)))]
    assert graph.enrich(symbols, found, opens, "nowhere").collect() == []
    assert sent < 100

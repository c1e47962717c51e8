"""Resolution queries for every language, and the same in SQL, which tries the steps name by name.

The derived facts have modules added, so that scopes, namespaces and parents matter, and imports of
single symbols, so that their order does. Separators are those of the language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import resolve
from .plans.adapters import Facts
from .registry import query

#: How qualified names of the derived facts are written in a language, as a Spark and a SQL expression.
_SLASHED = "regexp_replace({0}, '^([A-Z]+)[.]', '{1}1/')"


def _spelt(language: str, spark: bool) -> str:
    sep = resolve.RULES[language][0]
    if language == "go":  # the first part is a folder of the import path
        return _SLASHED.format("{0}", "$" if spark else "\\")
    if sep == ".":
        return "{0}"
    return f"replace({{0}}, '.', '{sep * 2 if spark and sep == chr(92) else sep}')"


def resolution_facts(f: Facts, language: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """wanted, symbols, opens in the spelling of a language."""
    spelt = _spelt(language, True)
    columns = ["id", "name", "qualified", "kind", "file"]
    module = F.substring_index("qualified", ".", 2)
    brand = F.substring_index("qualified", "_", -1).cast("int") % 4
    kind = F.when(brand == 0, "class").when(brand == 1, "module").when(brand == 2, "interface").otherwise("record")
    modules = f.symbols.groupBy(module.alias("qualified"), "file").agg((F.min("id") - 1_000_000_000).alias("id"))
    modules = modules.select("id", F.substring_index("qualified", ".", -1).alias("name"), "qualified", kind.alias("kind"), "file")
    symbols = f.symbols.select(*columns).unionByName(modules).withColumn("qualified", F.expr(spelt.format("qualified")))
    short = f.refs.filter(F.col("name").contains(".")).select(F.expr("substring(name, instr(name, '.') + 1)").alias("name"), "file")
    names = f.refs.select("name", "file").union(short.select("name", "file")).distinct()
    wanted = names.select(F.expr(spelt.format("name")).alias("name"), F.col("file").alias("from_file")).distinct()
    outer = f.opens.filter("ord % 2 = 0").select("file", F.substring_index("module_path", ".", 1).alias("module_path"), "ord")
    single = f.symbols.filter("id % 97 = 0").select(F.concat(F.lit("src/Brand_"), (F.col("id") % 25 + 1).cast("string"), F.lit(".py")).alias("file"), F.col("qualified").alias("module_path"), (F.col("id") % 7).cast("int").alias("ord"))
    opens = f.opens.select("file", "module_path", "ord").union(outer).union(single).distinct()
    return wanted, symbols, opens.withColumn("module_path", F.expr(spelt.format("module_path")))


def _facts_sql(language: str) -> str:
    s = _spelt(language, False)
    return f""", mods AS (SELECT min(id) - 1000000000 AS id, split_part(qualified, '.', 2) AS name, split_part(qualified, '.', 1) || '.' || split_part(qualified, '.', 2) AS qualified,
  CASE CAST(split_part(split_part(qualified, '.', 2), '_', 2) AS INT) % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'module' WHEN 2 THEN 'interface' ELSE 'record' END AS kind, file
  FROM symbols GROUP BY 2, 3, 4, 5),
syms AS MATERIALIZED (SELECT id, name, {s.format('qualified')} AS qualified, kind, file FROM (SELECT id, name, qualified, kind, file FROM symbols UNION ALL SELECT id, name, qualified, kind, file FROM mods)),
wanted AS MATERIALIZED (SELECT DISTINCT {s.format('name')} AS name, file FROM (SELECT name, file FROM refs UNION SELECT regexp_replace(name, '^[^.]*[.]', ''), file FROM refs WHERE contains(name, '.'))),
imports AS MATERIALIZED (SELECT DISTINCT file, {s.format('module_path')} AS module_path, ord FROM (SELECT file, module_path, ord FROM opens UNION SELECT file, split_part(module_path, '.', 1), ord FROM opens WHERE ord % 2 = 0
  UNION SELECT 'src/Brand_' || (id % 25 + 1) || '.py', qualified, CAST(id % 7 AS INT) FROM symbols WHERE id % 97 = 0)),
own AS MATERIALIZED (SELECT file, qualified, min(id) AS pos FROM syms GROUP BY 1, 2),
last AS MATERIALIZED (SELECT qualified, max(id) AS id, arg_max(file, id) AS file FROM syms GROUP BY 1)"""


def _resolve_sql(language: str) -> str:
    """Every candidate of every step with its place in the order of trial; the first that exists."""
    sep, steps = resolve.RULES[language]
    listed = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    parts = f"string_split(s.qualified, '{sep}')"
    space = f"array_to_string({parts}[:-2], '{sep}')"
    every = []

    def add(prio, via, candidate, place, source, known="NULL::BIGINT", text="''"):
        every.append(f"SELECT w.name, w.file, {candidate} AS cand, {known} AS own_id, {{'p': {prio}, 'a': {place[0]}, 'b': {place[1]}, 't': {text}, 'c': {place[2]}}} AS place, '{via}' AS resolution FROM wanted w {source}")

    for prio, step in enumerate(steps):
        kind, *args = (step,) if isinstance(step, str) else step
        via = resolve.NAMES[kind]
        if kind == "exact":
            add(prio, via, "w.name", (0, 0, 0), "")
        elif kind == "namespace":
            kinds, dotted = args
            also = f" OR contains({space}, '{sep}')" if dotted else ""
            first = f"(SELECT o.file, arg_min({space}, {{'a': o.pos, 'b': s.id}}) AS space FROM own o JOIN syms s ON s.qualified = o.qualified WHERE contains(s.qualified, '{sep}') AND (s.kind IN {listed(kinds)}{also}) GROUP BY 1)"
            add(prio, via, f"n.space || '{sep}' || w.name", (0, 0, 0), f"JOIN {first} n ON n.file = w.file")
        elif kind == "parents":
            ups = f"(SELECT file, pos, up, array_to_string({parts}[:-(up + 2)], '{sep}') AS scope FROM (SELECT o.file, o.pos, s.qualified, unnest(range(len({parts}) - 1)) AS up FROM own o JOIN last s ON s.qualified = o.qualified) s)"
            add(prio, via, f"u.scope || '{sep}' || w.name", ("u.pos", 0, "u.up"), f"JOIN (SELECT DISTINCT * FROM {ups}) u ON u.file = w.file")
        elif kind == "members":
            for c, rule in enumerate(args[0]):
                if rule == "scope":
                    add(prio, via, f"s.qualified || '{sep}' || w.name", ("o.pos", "s.id", c), f"JOIN own o ON o.file = w.file JOIN syms s ON s.qualified = o.qualified AND s.kind IN {listed(args[1])}")
                else:
                    also = f" OR ends_with(s.qualified, '{sep}' || w.name)" if rule == "ends" else ""
                    add(prio, via, "s.qualified", ("o.pos", "s.id", c), f"JOIN own o ON o.file = w.file JOIN syms s ON s.qualified = o.qualified AND (s.name = w.name{also})", "s.id")
        else:
            for c, rule in enumerate(args[0]):
                where, candidate = "", f"i.module_path || '{sep}' || w.name"
                if rule == "suffix":
                    where, candidate = f" AND ends_with(i.module_path, '{sep}' || w.name)", "i.module_path"
                elif rule == "tail":
                    where = " AND starts_with(w.name, string_split(i.module_path, '/')[-1] || '.')"
                    candidate = "i.module_path || substr(w.name, length(string_split(i.module_path, '/')[-1]) + 1)"
                add(prio, via, candidate, ("i.ord", 0, c), f"JOIN imports i ON i.file = w.file{where}", text="i.module_path")
    visible = " WHERE c.own_id IS NOT NULL OR coalesce((SELECT min(ord) FROM file_order x WHERE x.path = l.file) < (SELECT min(ord) FROM file_order y WHERE y.path = c.file), true)" if language == "fsharp" else ""
    picked = {"qualified": "cand", "symbol_id": "coalesce(own_id, id)", "resolution": "resolution"}
    out = ", ".join(f"arg_min({v}, {{'p': place, 'c': cand}}) AS {k}" for k, v in picked.items())
    return _facts_sql(language) + f", c AS ({' UNION ALL '.join(every)}) SELECT name, from_file, {out} FROM (SELECT c.name, c.file AS from_file, c.cand, c.own_id, c.place, c.resolution, l.id FROM c JOIN last l ON l.qualified = c.cand{visible}) GROUP BY 1, 2"


def _resolver(language: str) -> None:
    def run(f):
        wanted, symbols, opens = resolution_facts(f, language)
        order = f.order if language == "fsharp" else None
        return resolve.resolve(wanted, symbols, opens, language, order).select("name", "from_file", "qualified", "symbol_id", "resolution")

    run.__name__ = f"resolve_{language}"
    query(_resolve_sql(language))(run)


for _language in resolve.RULES:
    _resolver(_language)

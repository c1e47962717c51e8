"""Scanning, extraction, the store and the watch loop on small trees of our own."""

import os

import pytest
from pyspark.sql import functions as F

from symtrail import extract
from symtrail.extract import extract_text
from symtrail.sources import projects, scan
from symtrail.store import FactStore, StoreError
from symtrail.streaming import watch

# the same program in each language: helper, main calling it, a class and its child
PROGRAMS = {
    "a.py": ("def helper():\n    return 1\n\ndef main():\n    return helper()\n\nclass Base:\n    x = 1\n\nclass Child(Base):\n    pass\n", {"helper", "main", "Base", "Child", "Base.x"}, "Base"),
    "a.java": ("package p;\nimport q.R;\npublic class Base {\n  int helper() { return 1; }\n}\nclass Child extends Base {\n  int main() { return helper(); }\n}\n", {"p.Base", "p.Child", "p.Base.helper", "p.Child.main"}, "Base"),
    "a.ts": ("import { x } from './x';\nexport function helper(): number { return 1; }\nfunction main() { return helper(); }\nclass Base { run() { } }\nclass Child extends Base { }\n", {"helper", "main", "Base", "Child"}, "Base"),
    "a.js": ("const x = require('x');\nfunction helper() { return 1; }\nconst main = () => helper();\nclass Base { }\nclass Child extends Base { }\n", {"helper", "main", "Base", "Child"}, "Base"),
    "a.go": ("package p\nimport \"fmt\"\ntype Base struct { X int }\nfunc helper() int { return 1 }\nfunc Main() int { return helper() }\n", {"p.Base", "p.helper", "p.Main"}, None),
    "a.rs": ("use a::{b, c::d};\npub mod m {\n  pub fn helper() -> i32 { 1 }\n}\npub struct Base;\nfn main() { m::helper(); }\n", {"m", "m::helper", "Base", "main"}, None),
    "a.rb": ("require 'x'\nmodule M\n  class Base\n    def helper\n      1\n    end\n  end\n  class Child < Base\n  end\nend\n", {"M", "M::Base", "M::Base#helper", "M::Child"}, "Base"),
    "a.c": ("#include \"x.h\"\nint helper(void) {\n  return 1;\n}\nint main(void) {\n  return helper();\n}\nstruct Base { int x; };\n", {"helper", "main", "Base"}, None),
    "a.cpp": ("#include \"x.h\"\nnamespace n {\nint helper() { return 1; }\nclass Base { };\nclass Child : public Base { };\n}\n", {"n", "n::helper", "n::Base", "n::Child"}, "Base"),
    "a.cs": ("using X.Y;\nnamespace N {\n  public class Base { public int Helper() { return 1; } }\n  class Child : Base, IThing { }\n}\n", {"N", "N.Base", "N.Base.Helper", "N.Child"}, "Base"),
    "a.php": ("<?php\nnamespace N;\nuse X\\Y;\nclass Base { public function helper() { return 1; } }\nclass Child extends Base { }\n", {"N\\Base", "N\\Base\\helper", "N\\Child"}, "Base"),
    "a.kt": ("package p\nimport q.R\nopen class Base { fun helper(): Int { return 1 } }\nclass Child : Base() { }\nfun main() { }\n", {"p.Base", "p.Base.helper", "p.Child", "p.main"}, "Base"),
    "a.swift": ("import X\nclass Base { func helper() -> Int { return 1 } }\nclass Child: Base { }\nfunc main() { }\n", {"Base", "Base.helper", "Child", "main"}, "Base"),
    "a.fs": ("module M\nopen X.Y\nlet helper x = x\nlet main () = helper 1\ntype Base = { X: int }\n", {"M", "M.helper", "M.main", "M.Base"}, None),
    "a.m": ("#import \"x.h\"\n@interface Base : NSObject\n- (int)helper;\n@end\n@interface Child : Base\n@end\n", {"Base", "Base.helper", "Child"}, "Base"),
    "a.hx": ("package p;\nimport q.R;\nclass Base { function helper() { return 1; } }\nclass Child extends Base { }\n", {"p.Base", "p.Base.helper", "p.Child"}, "Base"),
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_same_program(name):
    source, expected, parent = PROGRAMS[name]
    found = extract_text(name, source)
    assert expected <= {s["qualified"] for s in found["symbols"]}
    if parent:
        assert any(s["name"] == "Child" and s["parent"] == parent for s in found["symbols"])
    if name not in ("a.py",):
        assert found["opens"]


def test_python_details():
    found = extract_text("x.pyi", "import a.b\nfrom . import c\nLIMIT = 1\nclass A:\n    é = 1\n    def __x(self):\n        return LIMIT\n    def __len__(self): ...\n")
    assert found["opens"] == ["a.b", "."]
    assert {(s["qualified"], s["kind"], s["visibility"]) for s in found["symbols"]} == {("LIMIT", "value", "public"), ("A", "class", "public"), ("A.é", "member", "public"), ("A.__x", "function", "private"), ("A.__len__", "function", "public")}
    assert ("LIMIT", 7) in {(r["name"], r["line"]) for r in found["refs"]}
    assert extract_text("x.py", "def (")["diagnostics"][0]["severity"] == "error"
    assert extract_text("x.unknown", "x") is None
    assert extract_text("x.rs", PROGRAMS["a.rs"][0])["opens"] == ["a::b", "a::c::d"]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "pkg" / "_hidden_not").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".secret").mkdir()
    (tmp_path / "out").mkdir()
    for name, body in {"pkg/__init__.py": "X = 1\n", "pkg/a.py": "def f():\n    return g()\n", "pkg/b.py": "def g():\n    return 1\n", "pkg/_hidden_not/c.py": "", "node_modules/n.js": "", ".secret/s.py": "", "out/o.py": "", "out/keep.py": "", "x.HX": "", "x.hx": ""}.items():
        (tmp_path / name).write_text(body)
    (tmp_path / ".gitignore").write_text("out/*\n!out/keep.py\n")
    return tmp_path


def test_scan(spark, tree):
    found = [os.path.relpath(p, tree) for p in scan.find_source_files(str(tree))]
    assert found == ["out/keep.py", "pkg/__init__.py", "pkg/_hidden_not/c.py", "pkg/a.py", "pkg/b.py"]
    assert "out/o.py" in [os.path.relpath(p, tree) for p in scan.find_source_files(str(tree), respect_gitignore=False)]
    (tree / scan.SETTINGS).write_text('exclude_dirs = ["pkg"]\n')
    assert [os.path.relpath(r["path"], tree) for r in scan.list_files(spark, str(tree)).collect()] == ["out/keep.py"]
    (tree / scan.SETTINGS).write_text("broken = [")
    assert scan.Config.load(str(tree)) == scan.Config()


def test_store_and_watch(spark, tree, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), buckets=4).create()
    with pytest.raises(StoreError):
        FactStore(spark, str(tmp_path / "store")).create()
    facts = extract.facts(extract.extract(scan.read_sources(scan.list_files(spark, str(tree)))))
    store.overwrite(**{k: facts[k] for k in ("symbols", "refs", "opens", "file_mtimes")})
    assert sorted(r["qualified"] for r in store.open().read("symbols").collect()) == ["X", "f", "g"]
    ids = [r["id"] for r in store.read("symbols").collect()]
    assert len(set(ids)) == len(ids)

    def fresh(paths):
        files = paths.withColumns({"mtime": F.lit(1).cast("long")})
        return {k: v for k, v in extract.facts(extract.extract(scan.read_sources(files)), store.next_id("symbols")).items() if k != "diagnostics"}

    (tree / "pkg" / "a.py").write_text("def h():\n    return g()\n")
    events = spark.createDataFrame([(1, "Modified", str(tree / "pkg/a.py"), None), (2, "Deleted", str(tree / "pkg/b.py"), None)], "seq long, op string, path string, new_path string").withColumn("ts", F.current_timestamp())
    assert watch.apply_batch(events, store, fresh, 0) == {"updated": 1, "deleted": 1, "skipped": 0}
    assert sorted(r["qualified"] for r in store.read("symbols").collect()) == ["X", "h"]
    assert [r["name"] for r in store.read("refs").filter(F.col("file").endswith("a.py")).collect()] == ["g"]
    assert watch.apply_batch(events, store, fresh, 0)["skipped"] == 1
    store.set_mtimes(spark.createDataFrame([("z", 5)], "path string, mtime long"))
    assert store.read("file_mtimes").filter("path = 'z'").first()["mtime"] == 5


def test_stream(spark, tree, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), buckets=2).create()
    log = tmp_path / "log"
    rows = [(1, "Created", str(tree / "pkg/a.py"), None), (2, "Created", str(tree / "pkg/b.py"), None)]
    spark.createDataFrame(rows, "seq long, op string, path string, new_path string").withColumn("ts", F.timestamp_seconds("seq")).select(*watch.EVENTS.names).write.parquet(str(log))

    def fresh(paths):
        files = paths.withColumn("mtime", F.lit(1).cast("long"))
        return {k: v for k, v in extract.facts(extract.extract(scan.read_sources(files))).items() if k != "diagnostics"}

    stream = spark.readStream.schema(watch.EVENTS).parquet(str(log))
    watch.watch(stream, store, fresh, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert sorted(r["qualified"] for r in store.read("symbols").collect()) == ["f", "g"]


def test_projects(spark, tmp_path):
    (tmp_path / "p.fsproj").write_text('<Project><ItemGroup><Compile Include="src\\B.fs"/><Compile Include="A.fs"/><PackageReference Include="X" Version="1"/></ItemGroup><Other><Compile Include="no.fs"/></Other></Project>')
    order = [(os.path.relpath(r["path"], tmp_path), r["ord"]) for r in projects.file_order(spark, str(tmp_path)).collect()]
    assert order == [("src/B.fs", 0), ("A.fs", 1)]
    assert projects.find_fsproj_for_file(str(tmp_path / "A.fs"), str(tmp_path)) == str(tmp_path / "p.fsproj")
    assert projects.external_in(projects.external_symbols(spark), "System.IO").count() == 23
    cache = tmp_path / "cache.json"
    cache.write_text('{"version": 1, "symbols": [{"name": "u", "qualified": "M.u", "type": "User list", "file": "a", "line": 1}, {"name": "u", "qualified": "M.u", "type": "int -> User", "file": "a", "line": 2}], "members": [{"type": "User", "member": "Name", "member_type": "string", "kind": "property"}]}')
    types, members = projects.read_type_cache(spark, str(cache))
    assert types.first()["type_signature"] == "int -> User" and members.count() == 1
    assert projects.expression_type(types, members, "u").first()["type_name"] == "User"
    cache.write_text('{"version": 2}')
    with pytest.raises(ValueError):
        projects.read_type_cache(spark, str(cache))

"""A tree built into a store, refreshed on read and watched; edits of an open document."""

import os

from symtrail import index


def test_build_refresh_and_watch(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def f():\n    return g()\n")
    (tree / "b.rs").write_text("/// Helps.\nfn g() { }\n")
    store = index.build(spark, str(tree), str(tmp_path / "store"))
    assert sorted(r["qualified"] for r in store.read("symbols").collect()) == ["f", "g"]
    assert {r["relation"]: r["n"] for r in index.counts(store).collect()}["file_mtimes"] == 2
    assert index.refresh(store, str(tree)) == 0
    (tree / "a.py").write_text("def h():\n    return 1\n")
    os.utime(tree / "a.py", (1, 1))
    (tree / "b.rs").unlink()
    (tree / "c.go").write_text("package p\nfunc New() { }\n")
    assert {(os.path.basename(r["path"]), r["reason"]) for r in index.changes(store, str(tree)).collect()} == {("a.py", "modified"), ("b.rs", "deleted"), ("c.go", "new")}
    assert sorted(r["qualified"] for r in index.fresh(store, str(tree), "symbols").collect()) == ["h", "p.New"]
    ids = [r["id"] for r in store.read("symbols").collect()]
    assert len(set(ids)) == 2
    (tree / "c.go").write_text("package p\nfunc Other() { }\n")
    os.utime(tree / "c.go", (2, 2))
    assert index.watch(store, str(tree), 0.0, lambda n: n == 2) == 1
    assert sorted(r["qualified"] for r in store.read("symbols").collect()) == ["h", "p.Other"]


def test_edits():
    text = "one\ntwo 𝄞x\nthree"
    assert index.edited(text, [((1, 0), (1, 3), "2")]) == "one\n2 𝄞x\nthree"
    assert index.edited(text, [((1, 6), (1, 7), "y")]) == "one\ntwo 𝄞y\nthree"
    assert index.edited(text, [((0, 3), (1, 0), " "), ((0, 0), (0, 0), ">")]) == ">one two 𝄞x\nthree"
    assert index.edited(text, [((9, 0), (9, 9), "!")]) == text + "!" and index.edited(text, [(None, None, "new")]) == "new"

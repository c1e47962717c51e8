"""Extraction queries: one program a language, in a file for each brand, and the symbols that it has."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import extract
from .registry import query

#: A program of each language, where N stands for the brand's number, with what it defines: qualified
#: name, kind, line, visibility, parent, doc, and the import.
PROGRAMS: dict[str, tuple[str, str, list[tuple]]] = {
    "java": (
        "java",
        "package p.q;\n"
        "import a.B;\n"
        "\n"
        "/** A base of N.\n"
        " * Second line. */\n"
        "@Service\n"
        "public class Base_N implements Runnable {\n"
        "    private int count;\n"
        "    /** Runs. */\n"
        "    @Override\n"
        "    public void run() { helper(); }\n"
        "}\n"
        "class Child_N extends Base_N { }\n"
        ,
        [
            ("p.q.Base_N", "class", 7, "public", None, "A base of N.\nSecond line.", "a.B"),
            ("p.q.Base_N.count", "value", 8, "private", None, None, "a.B"),
            ("p.q.Base_N.run", "function", 11, "public", None, "Runs.", "a.B"),
            ("p.q.Child_N", "class", 13, "internal", "Base_N", None, "a.B"),
        ],
    ),
    "kotlin": (
        "kt",
        "package p.q\n"
        "import a.B\n"
        "\n"
        "/** A base of N. */\n"
        "@Service\n"
        "open class Base_N : Runnable {\n"
        "    private val count = 1\n"
        "    override fun run() { helper() }\n"
        "}\n"
        "class Child_N : Base_N() { }\n"
        "fun main_N() { }\n"
        ,
        [
            ("p.q.Base_N", "class", 6, "public", None, "A base of N.", "a.B"),
            ("p.q.Base_N.count", "value", 7, "private", None, None, "a.B"),
            ("p.q.Base_N.run", "function", 8, "public", None, None, "a.B"),
            ("p.q.Child_N", "class", 10, "public", "Base_N", None, "a.B"),
            ("p.q.main_N", "function", 11, "public", None, None, "a.B"),
        ],
    ),
    "csharp": (
        "cs",
        "using A.B;\n"
        "namespace P.Q {\n"
        "    /// A base of N.\n"
        "    [Serializable]\n"
        "    public class Base_N : IRunnable {\n"
        "        public void Run() { Helper(); }\n"
        "    }\n"
        "    internal class Child_N : Base_N, IOther { }\n"
        "}\n"
        ,
        [
            ("P.Q", "module", 2, "public", None, None, "A.B"),
            ("P.Q.Base_N", "class", 5, "public", None, "A base of N.", "A.B"),
            ("P.Q.Base_N.Run", "function", 6, "public", None, None, "A.B"),
            ("P.Q.Child_N", "class", 8, "internal", "Base_N", None, "A.B"),
        ],
    ),
    "typescript": (
        "ts",
        "import { x } from './x';\n"
        "\n"
        "/** A base of N. */\n"
        "@Component({a: 1})\n"
        "export class Base_N {\n"
        "    run() { return x; }\n"
        "}\n"
        "export interface Shape_N { }\n"
        "class Child_N extends Base_N { }\n"
        "export function main_N() { }\n"
        ,
        [
            ("Base_N", "class", 5, "public", None, "A base of N.", "./x"),
            ("Base_N.run", "function", 6, "public", None, None, "./x"),
            ("Shape_N", "interface", 8, "public", None, None, "./x"),
            ("Child_N", "class", 9, "private", "Base_N", None, "./x"),
            ("main_N", "function", 10, "public", None, None, "./x"),
        ],
    ),
    "javascript": (
        "js",
        "const x = require('x');\n"
        "\n"
        "// A base of N.\n"
        "class Base_N {\n"
        "    run() { return x; }\n"
        "}\n"
        "class Child_N extends Base_N { }\n"
        "export function main_N() { }\n"
        ,
        [
            ("x", "value", 1, "private", None, None, "x"),
            ("Base_N", "class", 4, "private", None, "A base of N.", "x"),
            ("Base_N.run", "function", 5, "public", None, None, "x"),
            ("Child_N", "class", 7, "private", "Base_N", None, "x"),
            ("main_N", "function", 8, "public", None, None, "x"),
        ],
    ),
    "go": (
        "go",
        "package p\n"
        "\n"
        "import \"fmt\"\n"
        "\n"
        "// Base_N is a base.\n"
        "type Base_N struct { X int }\n"
        "\n"
        "func (b *Base_N) Run() { fmt.Println() }\n"
        "\n"
        "func main_N() { }\n"
        ,
        [
            ("p.Base_N", "class", 6, "public", None, "Base_N is a base.", "fmt"),
            ("p.Base_N.Run", "function", 8, "public", "Base_N", None, "fmt"),
            ("p.main_N", "function", 10, "private", None, None, "fmt"),
        ],
    ),
    "rust": (
        "rs",
        "use a::b;\n"
        "\n"
        "/// A base of N.\n"
        "#[derive(Debug)]\n"
        "pub struct Base_N;\n"
        "\n"
        "pub mod inner_N {\n"
        "    pub fn helper() { }\n"
        "}\n"
        "\n"
        "fn main_N() { inner_N::helper(); }\n"
        ,
        [
            ("Base_N", "class", 5, "public", None, "A base of N.", "a::b"),
            ("inner_N", "module", 7, "public", None, None, "a::b"),
            ("inner_N::helper", "function", 8, "public", None, None, "a::b"),
            ("main_N", "function", 11, "private", None, None, "a::b"),
        ],
    ),
    "ruby": (
        "rb",
        "require 'x'\n"
        "\n"
        "module M\n"
        "  # A base of N.\n"
        "  class Base_N\n"
        "    def run\n"
        "      helper\n"
        "    end\n"
        "  end\n"
        "  class Child_N < Base_N\n"
        "  end\n"
        "end\n"
        ,
        [
            ("M", "module", 3, "public", None, None, "x"),
            ("M::Base_N", "class", 5, "public", None, "A base of N.", "x"),
            ("M::Base_N#run", "function", 6, "public", None, None, "x"),
            ("M::Child_N", "class", 10, "public", "Base_N", None, "x"),
        ],
    ),
    "c": (
        "c",
        "#include \"x.h\"\n"
        "\n"
        "// Helps with N.\n"
        "int helper_N(void) {\n"
        "    return 1;\n"
        "}\n"
        "\n"
        "static int main_N(void) {\n"
        "    return helper_N();\n"
        "}\n"
        "\n"
        "struct base_N { int x; };\n"
        ,
        [
            ("helper_N", "function", 4, "public", None, "Helps with N.", "x.h"),
            ("main_N", "function", 8, "private", None, None, "x.h"),
            ("base_N", "class", 12, "public", None, None, "x.h"),
        ],
    ),
    "cpp": (
        "cpp",
        "#include \"x.h\"\n"
        "\n"
        "namespace n {\n"
        "// A base of N.\n"
        "class Base_N {\n"
        "};\n"
        "class Child_N : public Base_N { };\n"
        "int helper_N() {\n"
        "    return 1;\n"
        "}\n"
        "}\n"
        ,
        [
            ("n", "module", 3, "public", None, None, "x.h"),
            ("n::Base_N", "class", 5, "public", None, "A base of N.", "x.h"),
            ("n::Child_N", "class", 7, "public", "Base_N", None, "x.h"),
            ("n::helper_N", "function", 8, "public", None, None, "x.h"),
        ],
    ),
    "php": (
        "php",
        "<?php\n"
        "namespace P\\Q;\n"
        "use A\\B;\n"
        "\n"
        "/** A base of N. */\n"
        "#[Entity]\n"
        "class Base_N {\n"
        "    public function run() { return 1; }\n"
        "}\n"
        "class Child_N extends Base_N { }\n"
        ,
        [
            ("P\\Q\\Base_N", "class", 7, "public", None, "A base of N.", "A\\B"),
            ("P\\Q\\Base_N\\run", "function", 8, "public", None, None, "A\\B"),
            ("P\\Q\\Child_N", "class", 10, "public", "Base_N", None, "A\\B"),
        ],
    ),
    "swift": (
        "swift",
        "import X\n"
        "\n"
        "/// A base of N.\n"
        "@objc\n"
        "public class Base_N {\n"
        "    func run() -> Int { return 1 }\n"
        "}\n"
        "class Child_N: Base_N { }\n"
        "func main_N() { }\n"
        ,
        [
            ("Base_N", "class", 5, "public", None, "A base of N.", "X"),
            ("Base_N.run", "function", 6, "internal", None, None, "X"),
            ("Child_N", "class", 8, "internal", "Base_N", None, "X"),
            ("main_N", "function", 9, "internal", None, None, "X"),
        ],
    ),
    "fsharp": (
        "fs",
        "module P.Q\n"
        "\n"
        "open A.B\n"
        "\n"
        "/// Helps with N.\n"
        "let helper_N x = x\n"
        "\n"
        "let main_N () = helper_N 1\n"
        "\n"
        "type Base_N = { X: int }\n"
        ,
        [
            ("P.Q", "module", 1, "public", None, None, "A.B"),
            ("P.Q.helper_N", "function", 6, "public", None, "Helps with N.", "A.B"),
            ("P.Q.main_N", "function", 8, "public", None, None, "A.B"),
            ("P.Q.Base_N", "type", 10, "public", None, None, "A.B"),
        ],
    ),
    "objc": (
        "m",
        "#import \"x.h\"\n"
        "\n"
        "/// A base of N.\n"
        "@interface Base_N : Root\n"
        "- (int)run;\n"
        "@end\n"
        "@interface Child_N : Base_N\n"
        "@end\n"
        ,
        [
            ("Base_N", "class", 4, "public", "Root", "A base of N.", "x.h"),
            ("Base_N.run", "function", 5, "public", None, None, "x.h"),
            ("Child_N", "class", 7, "public", "Base_N", None, "x.h"),
        ],
    ),
    "haxe": (
        "hx",
        "package p.q;\n"
        "import a.B;\n"
        "\n"
        "/** A base of N. */\n"
        "class Base_N {\n"
        "    public function run() { return 1; }\n"
        "}\n"
        "class Child_N extends Base_N { }\n"
        ,
        [
            ("p.q.Base_N", "class", 5, "private", None, "A base of N.", "a.B"),
            ("p.q.Base_N.run", "function", 6, "public", None, None, "a.B"),
            ("p.q.Child_N", "class", 8, "private", "Base_N", None, "a.B"),
        ],
    ),
    "python": (
        "py",
        "import a.b\n"
        "\n"
        "\n"
        "class Base_N:\n"
        "    \"\"\"A base of N.\"\"\"\n"
        "\n"
        "    def run(self):\n"
        "        return helper()\n"
        "\n"
        "\n"
        "@cached\n"
        "class Child_N(Base_N):\n"
        "    pass\n"
        "\n"
        "\n"
        "def main_N():\n"
        "    return Base_N()\n"
        ,
        [
            ("Base_N", "class", 4, "public", None, "A base of N.", "a.b"),
            ("Base_N.run", "function", 7, "public", None, None, "a.b"),
            ("Child_N", "class", 12, "public", "Base_N", None, "a.b"),
            ("main_N", "function", 16, "public", None, None, "a.b"),
        ],
    ),
}


def _sql_text(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return str(value) if isinstance(value, int) else "replace('" + value.replace("'", "''") + "', 'N', k)"


def _extraction(language: str) -> None:
    ending, source, symbols = PROGRAMS[language]
    columns = ("qualified", "kind", "line", "visibility", "parent", "doc", "import_path")
    each = " UNION ALL ".join("SELECT concat('src/', k, '.', '" + ending + "') AS file, " + ", ".join(f"{_sql_text(v)} AS {c}" for c, v in zip(columns, s, strict=True)) + " FROM brands" for s in symbols)
    sql = f", brands AS (SELECT DISTINCT string_split(regexp_replace(file, '[.]py$', ''), '_')[-1] AS k FROM symbols) {each}"

    def run(f):
        k = F.regexp_extract("file", r"_(\d+)\.py$", 1)
        files = f.symbols.select(k.alias("k")).distinct()
        path = F.concat(F.lit("src/"), "k", F.lit(f".{ending}"))
        sources = files.select(path.alias("path"), F.lit(0).cast("long").alias("mtime"), F.replace(F.lit(source), F.lit("N"), F.col("k")).alias("content"))
        facts = extract.facts(extract.extract(sources))
        opens = facts["opens"].filter("ord = 1").select("file", F.col("module_path").alias("import_path"))
        return facts["symbols"].join(opens, "file").select("file", *columns)

    run.__name__ = f"extract_{language}"
    query(sql)(run)


for _language in PROGRAMS:
    _extraction(_language)

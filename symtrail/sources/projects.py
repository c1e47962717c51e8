"""Project files, type caches, external types and version control as tables."""

from __future__ import annotations

import glob
import os
import subprocess
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.history import log_line

# --- F# projects -----------------------------------------------------------------------------------


def find_fsproj_files(root: str) -> list[str]:
    """Project files in the root and in the folders right below it."""
    return sorted(glob.glob(os.path.join(glob.escape(root), "*.fsproj"))) + sorted(glob.glob(os.path.join(glob.escape(root), "*", "*.fsproj")))


def parse_fsproj(content: str, folder: str) -> dict[str, list]:
    """compile (paths in order), projects (paths), packages (name, version), of item groups only."""
    out: dict[str, list] = {"compile": [], "projects": [], "packages": []}
    for group in (e for e in ET.fromstring(content).iter() if e.tag.rsplit("}", 1)[-1] == "ItemGroup"):
        for item in group:
            include, tag = item.get("Include"), item.tag.rsplit("}", 1)[-1]
            if include is None:
                continue
            path = os.path.normpath(os.path.join(folder, include.replace("\\", "/")))
            if tag == "Compile":
                out["compile"].append(path)
            elif tag == "ProjectReference":
                out["projects"].append(path)
            elif tag == "PackageReference":
                out["packages"].append((include, item.get("Version")))
    return out


def find_fsproj_for_file(file: str, root: str) -> str | None:
    """The nearest project above the file, up to root, that compiles it."""
    file, root = os.path.abspath(file), os.path.abspath(root)
    folder = os.path.dirname(file)
    while folder.startswith(root):
        for project in sorted(glob.glob(os.path.join(glob.escape(folder), "*.fsproj"))):
            with open(project, encoding="utf-8") as f:
                if file in parse_fsproj(f.read(), folder)["compile"]:
                    return project
        if folder == os.path.dirname(folder):
            break
        folder = os.path.dirname(folder)
    return None


def file_order(spark: SparkSession, root: str) -> DataFrame:
    """path, ord: the compile order over all projects; of repeated files the first place counts."""
    files: list[str] = []
    for project in find_fsproj_files(root):
        with open(project, encoding="utf-8") as f:
            files += parse_fsproj(f.read(), os.path.dirname(project))["compile"]
    return spark.createDataFrame(list(dict.fromkeys(files)) and [(p, i) for i, p in enumerate(dict.fromkeys(files))], "path string, ord int")


# --- type caches -----------------------------------------------------------------------------------

_PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
_TYPED = T.StructType([*(T.StructField(n, T.StringType()) for n in ("name", "qualified", "type", "file")), T.StructField("line", T.IntegerType()), T.StructField("parameters", T.ArrayType(_PARAMETER))])
_MEMBER = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "member", "member_type", "kind")])
CACHE = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("extracted_at", T.StringType()), T.StructField("project", T.StringType()),
    T.StructField("symbols", T.ArrayType(_TYPED)), T.StructField("members", T.ArrayType(_MEMBER)),
])
CACHE_VERSION = 1


def read_type_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(qualified, name, type_signature, file, line, parameters) and the members of a cache file.
    Of repeated qualified names the last counts; other versions than CACHE_VERSION are an error."""
    cache = spark.read.schema(CACHE).json(path, multiLine=True, mode="FAILFAST")
    version = cache.select("version").first()
    if version is None or version[0] != CACHE_VERSION:
        raise ValueError(f"type cache version {version and version[0]}; {CACHE_VERSION} is expected")
    each = cache.select(F.posexplode("symbols").alias("i", "s"))
    typed = each.groupBy("s.qualified").agg(F.max_by("s", "i").alias("s")).select("s.qualified", "s.name", F.col("s.type").alias("type_signature"), "s.file", "s.line", "s.parameters")
    members = cache.select(F.posexplode("members").alias("i", "m")).select(F.col("i").cast("long").alias("id"), F.col("m.type").alias("type_name"), F.col("m.member").alias("member_name"), "m.member_type", F.coalesce("m.kind", F.lit("property")).alias("kind"))
    return typed, members


def expression_type(types: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """type_name: what an expression's members are looked up by: the name itself if it has members,
    else the simple type of the symbol of that qualified name or last segment."""
    from ..functions.text import last_segment, simple_type_name
    from ..operators.search import cascade

    own = members.filter(F.col("type_name") == name).select("type_name").limit(1)
    simple = simple_type_name(F.col("type_signature")).alias("type_name")
    exact = types.filter(F.col("qualified") == name).select(simple).limit(1)
    segment = types.filter(last_segment(F.col("qualified")) == name).orderBy("qualified").select(simple).limit(1)
    return cascade(own, exact, segment).select("type_name")


# --- external types --------------------------------------------------------------------------------

# The known types of the platform, their assemblies and their members (methods, and
# properties after a bar). A backtick tells the number of type parameters.
EXTERNAL = """
System.Runtime: System.Object, System.String, System.Int32, System.Int64, System.Double, System.Single, System.Boolean, System.Char, System.Byte
System.Runtime: System.DateTime, System.TimeSpan, System.Guid, System.Uri
System.Runtime: System.Exception, System.ArgumentException, System.InvalidOperationException, System.NotImplementedException
System.Console: System.Console(WriteLine Write ReadLine ReadKey Clear)
System.IO: System.IO.File(ReadAllText WriteAllText ReadAllLines WriteAllLines Exists Delete Copy Move)
System.IO: System.IO.Directory(Exists CreateDirectory Delete GetFiles GetDirectories)
System.IO: System.IO.Path(Combine GetFileName GetDirectoryName GetExtension GetFullPath), System.IO.StreamReader, System.IO.StreamWriter
System.Collections: System.Collections.Generic.List`1(Add Remove Clear Contains | Count)
System.Collections: System.Collections.Generic.Dictionary`2(Add Remove ContainsKey TryGetValue | Count Keys Values)
System.Collections: System.Collections.Generic.HashSet`1, System.Collections.Generic.Queue`1, System.Collections.Generic.Stack`1
System.Linq: System.Linq.Enumerable(Select Where First FirstOrDefault Last LastOrDefault Single SingleOrDefault ToList ToArray ToDictionary Count Any All Skip Take OrderBy OrderByDescending GroupBy Distinct Concat Zip)
System.Runtime: System.Text.StringBuilder(Append AppendLine Clear ToString)
System.Text.RegularExpressions: System.Text.RegularExpressions.Regex(Match Matches Replace IsMatch)
System.Runtime: System.Threading.Tasks.Task(Run WhenAll WhenAny Delay), System.Threading.Tasks.Task`1
System.Net.Http: System.Net.Http.HttpClient(GetAsync PostAsync PutAsync DeleteAsync SendAsync)
"""


def external_symbols(spark: SparkSession) -> DataFrame:
    """name, qualified, kind, assembly of the known external types and members; a short, fixed table."""
    rows = []
    for line in EXTERNAL.strip().splitlines():
        assembly, types = line.split(": ")
        for one in types.split(", "):
            qualified, _, members = one.rstrip(")").partition("(")
            methods, _, properties = members.partition("|")
            rows.append((qualified.rsplit(".", 1)[-1], qualified, "class", assembly))
            rows += [(m, f"{qualified}.{m}", kind, assembly) for kind, names in (("function", methods), ("value", properties)) for m in names.split()]
    return spark.createDataFrame(rows, "name string, qualified string, kind string, assembly string")


def external_exact(external: DataFrame, qualified: str) -> DataFrame:
    return external.filter(F.col("qualified") == qualified)


def search_external(external: DataFrame, pattern: str) -> DataFrame:
    return external.filter(F.col("name").contains(pattern) | F.col("qualified").contains(pattern))


def external_in(external: DataFrame, assembly: str) -> DataFrame:
    return external.filter(F.col("assembly") == assembly)


# --- version control -------------------------------------------------------------------------------


def history(spark: SparkSession, file: str, first: int, last: int) -> DataFrame:
    """The commits that touched a range of lines, newest first; empty outside a repository."""
    folder = os.path.dirname(os.path.abspath(file))
    made = subprocess.run(["git", "-C", folder, "log", "-s", f"-L{first},{last}:{os.path.basename(file)}", "--format=%h|%an|%as|%ar|%s", "--abbrev=12"], capture_output=True, text=True)
    lines = [(i, x) for i, x in enumerate(made.stdout.splitlines())] if made.returncode == 0 else []
    return spark.createDataFrame(lines, "ord int, line string").select("ord", log_line(F.col("line")).alias("c")).filter("c is not null").select("ord", "c.*").orderBy("ord")


def blame(spark: SparkSession, file: str, line: int) -> DataFrame:
    """The commit that a line comes from; empty for lines that aren't committed."""
    folder = os.path.dirname(os.path.abspath(file))
    made = subprocess.run(["git", "-C", folder, "blame", "--porcelain", f"-L{line},{line}", os.path.basename(file)], capture_output=True, text=True)
    commit = made.stdout.split(" ", 1)[0] if made.returncode == 0 else ""
    if not commit.strip("0"):
        return history(spark, "/nowhere", 1, 1)
    return commit_info(spark, folder, commit)


def commit_info(spark: SparkSession, folder: str, commit: str) -> DataFrame:
    made = subprocess.run(["git", "-C", folder, "show", "-s", "--format=%h|%an|%as|%ar|%s", "--abbrev=12", commit], capture_output=True, text=True)
    lines = [(i, x) for i, x in enumerate(made.stdout.splitlines())]
    return spark.createDataFrame(lines, "ord int, line string").select("ord", log_line(F.col("line")).alias("c")).filter("c is not null").select("ord", "c.*")

"""Finding source files, with exclusions and ignore files, and reading them as a DataFrame."""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..streaming.watch import SUPPORTED

# Folders that are never scanned, and the defaults of a project's settings.
EXCLUDED = ("node_modules", "bin", "obj", ".git", ".vs", ".idea", "target", "dist")
MAX_DEPTH = 500
SETTINGS = ".symtrail.toml"


@dataclass
class Config:
    exclude_dirs: list[str] = field(default_factory=list)
    max_recursion_depth: int = MAX_DEPTH
    respect_gitignore: bool = True

    @classmethod
    def load(cls, root: str, name: str = SETTINGS) -> Config:
        """The project's settings; defaults for what is missing, or if the file can't be read."""
        try:
            with open(os.path.join(root, name), "rb") as f:
                values = tomllib.load(f)
            return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__})
        except (OSError, tomllib.TOMLDecodeError, TypeError):
            return cls()

    def excluded_dirs(self) -> list[str]:
        return list(dict.fromkeys([*EXCLUDED, *self.exclude_dirs]))


def is_supported(path: str) -> bool:
    return "." in os.path.basename(path) and path.rsplit(".", 1)[1] in SUPPORTED


class Ignore:
    """The rules of one ignore file: patterns, negation, anchors, folders only, `**`."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for raw in lines:
            line = raw.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            body = line.strip("/")
            anchored = "/" in line.rstrip("/")
            self.rules.append((re.compile(self._regex(body, anchored)), keep, only_dirs))

    @staticmethod
    def _regex(body: str, anchored: bool) -> str:
        out = []
        for part in re.split(r"(\*\*/|/\*\*$|\*\*)", body):
            if part == "**/":
                out.append("(?:.*/)?")
            elif part == "/**":
                out.append("/.*")
            elif part == "**":
                out.append(".*")
            else:
                out.append(fnmatch.translate(part)[:-2].removeprefix("(?s:").removesuffix(")").replace(".*", "[^/]*") if part else "")
        return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$"

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept by a negation; None: no rule speaks."""
        relative = os.path.relpath(path, self.folder)
        found = None
        for pattern, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.match(relative):
                found = not keep
        return found


def _rules_in(folder: str) -> list[Ignore]:
    found = []
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                found.append(Ignore(folder, f.readlines()))
        except OSError:
            continue
    return found


def find_source_files(root: str, exclude_dirs: list[str] | None = None, respect_gitignore: bool = True) -> list[str]:
    """The supported files under root, sorted; hidden entries and excluded folders are left out.

    Spark's own listing can't do this: it skips names that begin with an underscore, __init__.py
    among them.
    """
    excluded = set(EXCLUDED if exclude_dirs is None else exclude_dirs)
    found: list[str] = []

    def walk(folder: str, ignores: list[Ignore]) -> None:
        own = [*ignores, *_rules_in(folder)] if respect_gitignore else []

        def ignored(path: str, is_dir: bool) -> bool:
            for rules in reversed(own):  # the nearest file that speaks decides
                if (v := rules.verdict(path, is_dir)) is not None:
                    return v
            return False

        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.name.startswith("."):
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name not in excluded and not ignored(e.path, True):
                    walk(e.path, own)
            elif e.is_file() and is_supported(e.path) and not ignored(e.path, False):
                found.append(e.path)

    parents, at = [], os.path.dirname(os.path.abspath(root))
    while respect_gitignore and at != os.path.dirname(at):
        parents = [*_rules_in(at), *parents]
        at = os.path.dirname(at)
    walk(os.path.abspath(root), parents)
    return found


def list_files(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """path, mtime in seconds, size of each source file of a project."""
    config = config or Config.load(root)
    rows = []
    for path in find_source_files(root, config.excluded_dirs(), config.respect_gitignore):
        info = os.stat(path)
        rows.append((path, int(info.st_mtime), info.st_size))
    return spark.createDataFrame(rows, "path string, mtime long, size long")


def read_sources(files: DataFrame) -> DataFrame:
    """files (path) with content; a file that can't be read has none. Read on the executors, which
    need to see the paths."""

    def rows(batches):
        for batch in batches:
            content = []
            for path in batch["path"]:
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield batch.assign(content=content)

    from pyspark.sql import types as T

    return files.mapInPandas(rows, T.StructType([*files.schema.fields, T.StructField("content", T.StringType())]))

"""A file tree as rows: a Python data source, since Spark's own file listing hides names that begin with a dot.

Options: path, include and exclude (comma-separated prefixes; default from the tree's config file), state_dir, partitions.
Rows: kind (file, unreadable, skipped or excluded), path, size, mode, mtime_secs, mtime_nanos. Directories that filters
exclude are not entered. The driver lists, partitions look at the files."""

from __future__ import annotations

import os
import re
import stat
import tomllib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import DataFrame, SparkSession

from treeline.operators.predicates import BUILTIN_EXCLUDES, STATE_DIR

SCHEMA = "kind string, path string, size bigint, mode int, mtime_secs bigint, mtime_nanos bigint"


def load_config(root: str, name: str = "treeline.toml") -> tuple[list[str], list[str]]:
    """include and exclude of the [sync] table; what is absent or can't be parsed counts as empty."""
    try:
        with open(os.path.join(root, name), "rb") as f:
            own = tomllib.load(f).get("sync", {})
        tidy = lambda v: [p for x in v if isinstance(x, str) and (p := x.strip("/"))] if isinstance(v, list) else []
        return tidy(own.get("include", [])), tidy(own.get("exclude", []))
    except (OSError, tomllib.TOMLDecodeError, AttributeError):
        return [], []


class IgnoreRules:
    """The patterns of one ignore file, by the rules of git's documentation."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dir = line.endswith("/")
            line = line.rstrip("/") if only_dir else line
            fixed = "/" in line
            body = self._regex(line.lstrip("/"))
            self.rules.append((re.compile(body if fixed else f"(?:.*/)?{body}", re.S), keep, only_dir))

    @staticmethod
    def _regex(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            rest = glob[i:]
            if rest.startswith("**/") and (i == 0 or glob[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif rest == "**" and (i == 0 or glob[i - 1] == "/"):
                out, i = out + ".+", i + 2
            elif rest[0] == "*":
                out, i = out + "[^/]*", i + 1
            elif rest[0] == "?":
                out, i = out + "[^/]", i + 1
            elif rest[0] == "[" and (end := glob.find("]", i + 2)) > 0:
                own = glob[i + 1 : end]
                out, i = out + "[" + ("^" + own[1:] if own[0] in "!^" else own).replace("\\", "\\\\") + "]", end + 1
            elif rest[0] == "\\" and len(rest) > 1:
                out, i = out + re.escape(rest[1]), i + 2
            else:
                out, i = out + re.escape(rest[0]), i + 1
        return out

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        """Ignored, kept by '!', or nothing said: the last rule that matches counts."""
        for pattern, keep, only_dir in reversed(self.rules):
            if (is_dir or not only_dir) and pattern.fullmatch(rel):
                return not keep
        return None


def _below(path: str, prefixes: list[str]) -> bool:
    return any(path == p or path.startswith(p + "/") for p in prefixes)


class Walk:
    """One walk gives what the two passes of the contract give: files that ignore rules leave, and .env files and the root
    .git whatever the rules say. The user's excludes stand above includes, those above built-in names, those above rules."""

    def __init__(self, root: str, include: list[str], exclude: list[str], state_dir: str = STATE_DIR):
        self.root, self.include, self.exclude, self.state = root, include, exclude, state_dir.lower()
        self.found: list[tuple[str, str]] = []

    def shadowed(self, rel: str) -> bool:
        parts = rel.split("/")
        for n in range(len(parts) - 1, 0, -1):
            above = "/".join(parts[:n])
            if _below(above, self.include):
                return False
            if parts[n - 1] in BUILTIN_EXCLUDES:
                return True
        return False

    def enters(self, rel: str, name: str) -> bool:
        """Whether a directory is entered at all, the ignore rules aside."""
        if name.lower() == self.state:
            return "/" in rel
        if _below(rel, self.exclude):
            return False
        if rel == ".git" or rel.startswith(".git/") or _below(rel, self.include):
            return True
        reaches = any(p.startswith(rel + "/") for p in self.include)
        if self.shadowed(rel):
            return False
        return name not in BUILTIN_EXCLUDES or reaches

    def takes(self, rel: str, name: str) -> bool:
        if ("/" not in rel and name.lower() == self.state) or _below(rel, self.exclude):
            return False
        return rel.startswith(".git/") or _below(rel, self.include) or not self.shadowed(rel)

    def run(self) -> list[tuple[str, str]]:
        rules = []
        try:
            with open(os.path.join(self.root, ".git/info/exclude"), encoding="utf-8", errors="replace") as f:
                rules.append(("", IgnoreRules(f.read())))
        except OSError:
            pass
        os.listdir(self.root)  # a root that can't be read fails the scan
        self._folder("", rules, False)
        return sorted(set(self.found))

    def _ignored(self, rel: str, is_dir: bool, rules: list) -> bool:
        for base, own in reversed(rules):
            verdict = own.verdict(rel[len(base) :], is_dir)
            if verdict is not None:
                return verdict
        return False

    def _folder(self, rel: str, rules: list, ignored: bool) -> None:
        """ignored: a directory above is, so that only what no rule may filter is taken below."""
        here = f"{rel}/" if rel else ""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
        except OSError:
            self.found.append(("unreadable", rel))
            return
        try:
            with open(os.path.join(self.root, here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules = [*rules, (here, IgnoreRules(f.read()))]
        except OSError:
            pass
        for e in entries:
            path = here + e.name
            try:
                path.encode()
            except UnicodeEncodeError:
                self.found.append(("skipped", path.encode("utf-8", "replace").decode()))
                continue
            in_git = path == ".git" or path.startswith(".git/")
            if e.is_symlink():
                if self.takes(path, e.name):
                    self.found.append(("skipped", path))
            elif e.is_dir(follow_symlinks=False):
                if not self.enters(path, e.name):
                    if e.name.lower() != self.state:
                        self.found.append(("excluded", path))
                    continue
                self._folder(path, rules, not in_git and (ignored or self._ignored(path, True, rules)))
            elif e.is_file(follow_symlinks=False) and self.takes(path, e.name):
                free = in_git or e.name.startswith(".env") or _below(path, self.include)
                if free or not (ignored or self._ignored(path, False, rules)):
                    self.found.append(("file", path))


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        include, exclude = load_config(self.root, options.get("config", "treeline.toml"))
        split = lambda name, own: [p for x in options[name].split(",") if (p := x.strip("/"))] if name in options else own
        self.include, self.exclude = split("include", include), split("exclude", exclude)
        self.state, self.many = options.get("state_dir", STATE_DIR), int(options.get("partitions", 8))

    def partitions(self) -> list[InputPartition]:
        found = Walk(self.root, self.include, self.exclude, self.state).run()
        size = max(1, -(-len(found) // self.many))
        return [_Part(found[i : i + size]) for i in range(0, len(found), size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for kind, path in partition.rows:
            if kind != "file":
                yield kind, path, None, None, None, None
                continue
            try:
                s = os.lstat(os.path.join(self.root, path))
            except FileNotFoundError:
                continue  # gone meanwhile
            except OSError:
                yield "unreadable", path, None, None, None, None
                continue
            yield "file", path, s.st_size, stat.S_IMODE(s.st_mode), s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(path=root, **options).load()


def strict(rows: DataFrame) -> DataFrame:
    """The files, or an error if something could not be read or was skipped."""
    from pyspark.sql import functions as F

    bad = F.col("kind").isin("unreadable", "skipped")
    return rows.where(F.when(bad, F.raise_error(F.concat(F.lit("not captured: "), "path"))).otherwise(F.col("kind") == "file"))

"""A source tree as a table: format "code_tree" with path, size, head and (only if asked for) content.

Options: path; respect_gitignore (true), parent_ignores (false), global_gitignore (false; true, or the file),
include_generated (false), include_hidden (true), additional_ignores (comma-separated globs),
sniff_shebangs (true), content (false).
The walk lists files in sorted order and follows no links; executors read heads and contents.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import dimensions

HEAD = 512
FILES_PER_PARTITION = 256
_KNOWN = {e for r in dimensions.LANGUAGES for e in r[2]} | {f for r in dimensions.LANGUAGES for f in r[3]}


def glob_regex(glob: str, crosses: bool = True) -> str:
    """A glob as a regular expression; in ignore files a star stays within a directory, elsewhere it crosses."""
    out, i = [], 0
    one = "." if crosses else "[^/]"
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"bad glob: {glob}")
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(glob_regex(x, crosses) for x in glob[i + 1 : end].split(",")) + ")")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


class Ignores:
    """The rules of one ignore file, relative to its directory; the last rule that fits decides.

    `base` is that directory in the tree; `over` is the way from it to the tree's root, if it is above.
    """

    def __init__(self, base: str, text: str, over: str = "") -> None:
        self.base, self.over, self.rules = base, over, []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            only_dir, line = line.endswith("/"), line.rstrip("/")
            if not line:
                continue
            anchored = "/" in line
            try:
                body = glob_regex(line.lstrip("/"), crosses=False)
            except ValueError:
                continue
            self.rules.append((re.compile(body if anchored else f"(?:.*/)?{body}"), negated, only_dir))

    def decide(self, path: str, is_dir: bool) -> bool | None:
        own = path[len(self.base) + 1 :] if self.base else f"{self.over}/{path}" if self.over else path
        found = None
        for rule, negated, only_dir in self.rules:
            if (is_dir or not only_dir) and rule.fullmatch(own):
                found = not negated
        return found


def _read(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def global_ignores() -> str:
    """The file of ignore rules that hold for all trees of a user."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(home, "git", "ignore")


def outer_rules(root: str, respect_gitignore: bool, parent_ignores: bool, global_gitignore: str | bool) -> list[Ignores]:
    """Rules that hold before any of the tree's own, the weakest first: of the user, of folders above, of the repository."""
    rules: list[Ignores] = []
    everywhere = global_ignores() if global_gitignore is True else global_gitignore
    if everywhere and os.path.isfile(everywhere):
        rules.append(Ignores("", _read(everywhere)))
    top = os.path.realpath(root)
    above, steps = os.path.dirname(top), [os.path.basename(top)]
    found: list[Ignores] = []
    while parent_ignores and above != os.path.dirname(above):
        names = [n for n in (".ignore", ".gitignore") if os.path.isfile(os.path.join(above, n))]
        found += [Ignores("", _read(os.path.join(above, n)), "/".join(reversed(steps))) for n in names]
        steps.append(os.path.basename(above))
        above = os.path.dirname(above)
    rules += reversed(found)
    exclude = os.path.join(root, ".git", "info", "exclude")
    if respect_gitignore and os.path.isfile(exclude):
        rules.append(Ignores("", _read(exclude)))
    return rules


def walk(
    root: str, respect_gitignore: bool = True, include_generated: bool = False, include_hidden: bool = True, additional_ignores: tuple[str, ...] = (), parent_ignores: bool = False, global_gitignore: str | bool = False
) -> list[str]:
    """Relative paths of all regular files that count, sorted by their components."""
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    extra = [re.compile(glob_regex(g.lstrip("/").removesuffix("/**")) + ("(?:/.*)?" if g.endswith("/**") else "")) for g in additional_ignores]
    out: list[str] = []
    stack: list[tuple[str, list[Ignores], frozenset[str]]] = [("", outer_rules(root, respect_gitignore, parent_ignores, global_gitignore), frozenset())]
    while stack:
        at, rules, above = stack.pop()
        entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        names = above | {e.name for e in entries if e.is_file(follow_symlinks=False)}
        if respect_gitignore:
            for e in entries:
                if e.name in (".gitignore", ".ignore") and e.is_file():
                    rules = [*rules, Ignores(at, _read(e.path))]
        for e in entries:
            path, is_dir = f"{at}/{e.name}" if at else e.name, e.is_dir(follow_symlinks=False)
            if e.is_symlink() or e.name == ".git" or not include_hidden and e.name.startswith("."):
                continue
            if any(x.fullmatch(path) for x in extra) or next((d for r in reversed(rules) if (d := r.decide(path, is_dir)) is not None), False):
                continue
            if is_dir:
                markers = dimensions.TRAVERSAL.get(e.name)
                if include_generated or markers is None or markers and not names & set(markers):
                    stack.append((path, rules, names))
            elif e.is_file(follow_symlinks=False):
                out.append(path)
    return sorted(out, key=lambda p: p.split("/"))


def safe(path: str) -> bool:
    """Whether a path is relative and stays in the tree."""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/")


def read_text(paths: DataFrame, root: str) -> DataFrame:
    """`paths` (path) with text and error: the files of a tree that all executors see; only paths that stay in it are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                text, error = None, None
                try:
                    if not safe(path or ""):
                        raise ValueError("the path must be relative and stay in the tree")
                    with open(os.path.join(root, path), "rb") as f:
                        text = f.read().decode("utf-8")
                except (OSError, ValueError) as e:  # UnicodeDecodeError is a ValueError
                    error = str(e)[:200]
                rows.append([path, text, error])
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return paths.select("path").mapInPandas(run, "path string, text string, error string")


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root, self.columns = options.get("path") or "", columns
        self.content, self.sniff = flag("content", "false"), flag("sniff_shebangs", "true")
        ignores = tuple(x for x in (options.get("additional_ignores") or "").split(",") if x)
        everywhere = str(options.get("global_gitignore", "false"))
        outer = {"parent_ignores": flag("parent_ignores", "false"), "global_gitignore": {"true": True, "false": False}.get(everywhere.lower(), everywhere)}
        self.walk = outer | {"respect_gitignore": flag("respect_gitignore", "true"), "include_generated": flag("include_generated", "false"), "include_hidden": flag("include_hidden", "true"), "additional_ignores": ignores}

    def partitions(self) -> list[Files]:
        paths = walk(self.root, **self.walk)
        return [Files(paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            name, full, head, text = os.path.basename(path), os.path.join(self.root, path), None, None
            try:
                size = os.path.getsize(full)
                known = name in _KNOWN or "." in name[1:] and name.rsplit(".", 1)[1].lower() in _KNOWN
                if self.content:
                    with open(full, "rb") as f:
                        raw = f.read()
                    try:
                        text = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        text = None
                if self.sniff and not known:
                    with open(full, "rb") as f:
                        line = f.read(HEAD).split(b"\n", 1)[0]
                    head = line.decode("utf-8") if line.startswith(b"#!") else None
                yield path, size, head, text, None
            except (OSError, UnicodeDecodeError) as e:
                yield path, 0, None, None, str(e)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "path string, size long, head string, text string, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)

"""Questions to an inventory: selections of its tables and predicates over its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dimensions
from .classify import extension

Tables = dict[str, DataFrame]


# ---- selections -------------------------------------------------------------------------------------


def file(t: Tables, path: str) -> DataFrame:
    return t["files"].filter(F.col("path") == path)


def package(t: Tables, ident: str) -> DataFrame:
    return t["packages"].filter(F.col("id") == ident)


def packages_at(t: Tables, root: str) -> DataFrame:
    return t["packages"].filter(F.col("root") == root)


def project(t: Tables, root: str) -> DataFrame:
    return t["projects"].filter(F.col("root") == root)


def workspace(t: Tables, root: str) -> DataFrame:
    """The workspaces at a root with their members."""
    members = t["members"].groupBy(F.col("workspace_root").alias("root")).agg(F.array_sort(F.collect_set("id")).alias("member_ids"))
    return t["workspaces"].filter(F.col("root") == root).join(members, "root", "left")


def artifacts_at(t: Tables, root: str) -> DataFrame:
    return t["artifacts"].filter(F.col("root") == root)


def artifacts_with_profile(t: Tables, profile: str) -> DataFrame:
    return t["artifacts"].filter(F.col("profile") == profile)


def files_with_language(t: Tables, language: str) -> DataFrame:
    return t["files"].filter(F.col("language") == language)


def files_for_package(t: Tables, ident: str) -> DataFrame:
    return t["files"].join(t["owners"].filter(F.col("package") == ident).select("path"), "path", "left_semi")


def package_owners(t: Tables, path: str) -> DataFrame:
    """The packages that own a file: one of each kind at most."""
    return t["packages"].join(t["owners"].filter(F.col("path") == path).select(F.col("package").alias("id")), "id", "left_semi")


# ---- predicates ---------------------------------------------------------------------------------------


def package_name(dependency: Column) -> Column:
    """What a dependency is called upstream, whatever it was renamed to."""
    return F.coalesce(dependency["package"], dependency["name"])


def depends_on(name: str) -> Column:
    return F.exists("dependencies", lambda d: package_name(d) == name)


def uses_ecosystem(name: str) -> Column:
    return F.array_contains("ecosystems", name)


def script(name: str) -> Column:
    """The command of a package's script; null if it has none of that name."""
    return F.get(F.filter("scripts", lambda s: s["name"] == name), F.lit(0))["command"]


def has_language(t: Tables, language: str) -> DataFrame:
    """The packages that use a language."""
    return t["packages"].join(t["package_languages"].filter(F.col("language") == language).select(F.col("package").alias("id")), "id", "left_semi")


def has_facet(facet: str) -> Column:
    return F.array_contains("facets", facet)


# ---- languages ----------------------------------------------------------------------------------------


def _extensions(language: str) -> list[str]:
    return next(list(r[2]) for r in dimensions.LANGUAGES if r[0] == language)


def detects_source(language: str, path: Column) -> Column:
    """Whether the file's extension is the language's own."""
    return F.coalesce(extension(path).isin(*_extensions(language)), F.lit(False))


def accepts_source(language: str, path: Column) -> Column:
    """Whether a project of that language takes the file as source."""
    return F.coalesce(extension(path).isin(*_extensions(language), *dimensions.OVERLAY_EXTENSIONS.get(language, ())), F.lit(False))


def supersedes(language: str, other: Column) -> Column:
    return other.isin(*dimensions.SUPERSEDES[language]) if language in dimensions.SUPERSEDES else F.lit(False)


def with_facet(languages: DataFrame, facet: str) -> DataFrame:
    """The rows whose language has a facet."""
    wanted = F.broadcast(dimensions.language_facets(languages.sparkSession).filter(F.col("facet") == facet).select("language"))
    return languages.join(wanted, "language", "left_semi")


def inline_test(language: Column, text: Column) -> Column:
    """What tells that a source file holds tests: by the first line, left-trimmed, that begins with a mark of its language."""

    def first(marks: tuple, imports: tuple = ()) -> Column:
        def mark(line: Column) -> Column:
            begun = [F.when(line.startswith(m), F.lit(name)) for m, name in marks]
            if imports:
                begun.append(F.when(line.startswith("import ") & reduce(Column.__or__, [line.contains(w) for w in imports]), F.lit("test framework import")))
            return F.coalesce(*begun)

        lines = F.transform(F.split(text, "\n"), lambda line: mark(F.regexp_replace(line, r"^\s+", "")))
        return F.get(F.array_compact(lines), F.lit(0))

    script_ = first(dimensions.INLINE_TESTS["javascript"], dimensions.TEST_IMPORTS)
    return F.when(language == "rust", first(dimensions.INLINE_TESTS["rust"])).when(language.isin("javascript", "typescript"), script_)

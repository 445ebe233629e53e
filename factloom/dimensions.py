"""Registry rows: small tables of a fixed size, safe to broadcast, checked when they are built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Syntax:
    """How a language writes comments and quotes."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    quotes: tuple[str, ...] = ()
    multi_quotes: tuple[str, ...] = ()


# Comment syntaxes.
SYNTAXES = {
    "js": Syntax(("//",), (("/*", "*/"),), ('"', "'"), ("`",)),
    "c-like": Syntax(("//",), (("/*", "*/"),), ('"', "'")),
    "rust": Syntax(("//",), (("/*", "*/"),), ('"',)),
    "php": Syntax(("//", "#"), (("/*", "*/"),), ('"', "'")),
    "css": Syntax((), (("/*", "*/"),), ('"', "'")),
    "css-nested": Syntax(("//",), (("/*", "*/"),), ('"', "'")),
    "hash": Syntax(("#",), (), ('"', "'")),
    "python": Syntax(("#",), (), ('"', "'"), ('"""', "'''")),
    "sql": Syntax(("--",), (("/*", "*/"),), ('"', "'")),
    "html": Syntax((), (("<!--", "-->"),)),
    "sfc": Syntax(("//",), (("/*", "*/"), ("<!--", "-->")), ('"', "'"), ("`",)),
}

# Id, role, extensions, filenames, interpreters, comment syntax.
LANGUAGES = [
    ("c", "programming", ["c", "h"], [], [], "c-like"),
    ("c-sharp", "programming", ["cs"], [], [], "c-like"),
    ("cpp", "programming", ["cc", "cpp", "cxx", "hh", "hpp", "hxx"], [], [], "c-like"),
    ("css", "stylesheet", ["css"], [], [], "css"),
    ("dockerfile", "build", [], ["Dockerfile", "Containerfile"], [], "hash"),
    ("go", "programming", ["go"], [], [], "c-like"),
    ("html", "markup", ["html", "htm"], [], [], "html"),
    ("java", "programming", ["java"], [], [], "c-like"),
    ("javascript", "programming", ["js", "jsx", "mjs", "cjs"], [], ["node", "bun", "deno"], "js"),
    ("json", "data", ["json", "jsonc"], [], [], None),
    ("kotlin", "programming", ["kt", "kts"], [], [], "c-like"),
    ("less", "stylesheet", ["less"], [], [], "css-nested"),
    ("make", "build", ["mk"], ["Makefile", "GNUmakefile"], [], "hash"),
    ("markdown", "documentation", ["md", "mdx", "markdown"], [], [], None),
    ("php", "programming", ["php"], [], ["php"], "php"),
    ("python", "programming", ["py", "pyi"], [], ["python"], "python"),
    ("ruby", "programming", ["rb", "rake"], ["Gemfile", "Rakefile"], ["ruby"], "hash"),
    ("rust", "programming", ["rs"], [], [], "rust"),
    ("scala", "programming", ["scala"], [], [], "c-like"),
    ("scss", "stylesheet", ["scss", "sass"], [], [], "css-nested"),
    ("shell", "programming", ["sh", "bash", "zsh", "fish"], [], ["sh", "bash", "zsh", "fish"], "hash"),
    ("sql", "programming", ["sql"], [], [], "sql"),
    ("svelte", "programming", ["svelte"], [], [], "sfc"),
    ("swift", "programming", ["swift"], [], [], "c-like"),
    ("toml", "data", ["toml"], [], [], "hash"),
    ("typescript", "programming", ["ts", "tsx", "mts", "cts"], [], [], "js"),
    ("vue", "programming", ["vue"], [], [], "sfc"),
    ("yaml", "data", ["yaml", "yml"], [], [], "hash"),
    ("zig", "programming", ["zig"], [], [], "c-like"),
]

# Id, lockfiles in order, implied language, how pins are written.
ECOSYSTEMS = [
    ("bun", ["bun.lock", "bun.lockb"], "javascript", "exact-semver"),
    ("cargo", ["Cargo.lock"], "rust", "cargo-exact"),
    ("npm", ["package-lock.json", "npm-shrinkwrap.json"], "javascript", "exact-semver"),
    ("pnpm", ["pnpm-lock.yaml"], "javascript", "exact-semver"),
    ("yarn", ["yarn.lock"], "javascript", "exact-semver"),
]


def check() -> None:
    """Ids are unique and sorted, and no extension, filename or lockfile has two owners."""
    for rows in (LANGUAGES, ECOSYSTEMS):
        ids = [r[0] for r in rows]
        if ids != sorted(set(ids)):
            raise ValueError("registry ids must be unique and sorted")
    for column in (2, 3):
        names = [x for r in LANGUAGES for x in r[column]]
        if len(names) != len(set(names)):
            raise ValueError("an extension or filename has two languages")
    if any(r[5] and r[5] not in SYNTAXES for r in LANGUAGES):
        raise ValueError("unknown comment syntax")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, role string, extensions array<string>, filenames array<string>, interpreters array<string>, syntax string")


def ecosystems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ECOSYSTEMS, "ecosystem string, lockfiles array<string>, implies string, pins string")


# Configuration files and dependencies that tell a project's language.
LANGUAGE_CONFIGS = {"javascript": ("jsconfig.json",), "typescript": ("tsconfig.json",)}
LANGUAGE_DEPENDENCIES = {"typescript": ("typescript",)}
# Extensions that a language takes besides its own where a project uses it, and the language it stands before.
OVERLAY_EXTENSIONS = {"typescript": ("js", "jsx", "mjs", "cjs")}
SUPERSEDES = {"typescript": ("javascript",)}
# What the source of a language can hold.
LANGUAGE_FACETS = {
    "component-host": ("javascript", "svelte", "typescript", "vue"),
    "structured-code": ("c", "c-sharp", "cpp", "go", "java", "javascript", "kotlin", "php", "python", "ruby", "rust", "scala", "shell", "svelte", "swift", "typescript", "vue", "zig"),
    "style-host": ("css", "html", "javascript", "less", "scss", "svelte", "typescript", "vue"),
}
# Packages and configuration files of web sites and desktop applications.
WEB_PACKAGES = ("vite", "next", "astro", "@sveltejs/kit", "parcel")
WEB_CONFIGS = ("vite.config.ts", "vite.config.js", "next.config.ts", "next.config.js", "astro.config.ts", "astro.config.mjs", "svelte.config.js")
TAURI_CONFIGS = ("tauri.conf.json", "tauri.conf.json5")
# Facet and what a project with it makes; profile, dependencies and words of scripts that make it.
FACET_ARTIFACTS = (("static-site", "site"), ("tauri", "tauri"))
PACKAGE_ARTIFACTS = (("binary", (), ("bun build --compile",)), ("napi", ("@napi-rs/cli",), ("napi build",)))
# How lines begin that make a file hold tests, in the order they are tried; then words of imports.
INLINE_TESTS = {
    "rust": (("#[cfg(test)]", "#[cfg(test)]"), ("#[test]", "#[test]"), ("mod tests", "mod tests")),
    "javascript": (("describe(", "describe"), ("describe.", "describe"), ("it(", "it"), ("it.", "it"), ("test(", "test"), ("test.", "test")),
}
TEST_IMPORTS = ('from "vitest"', "from 'vitest'", "@jest/globals", "node:test")


def language_facets(spark: SparkSession) -> DataFrame:
    """(language, facet)."""
    return spark.createDataFrame([(lang, f) for f, ls in LANGUAGE_FACETS.items() for lang in ls], "language string, facet string")


@dataclass(frozen=True)
class Command:
    """What a tool's command line must look like, and what it then does."""

    prefix: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ("build",)
    required: tuple[str, ...] = ()
    rejected: tuple[str, ...] = ()
    artifacts: tuple[str, ...] = ()


_SCRIPT = ("javascript", "typescript")
_COMPILE = ("--compile", "--compile=*")
# Id, programs, languages, commands. A required or rejected argument ending in * is a prefix.
TOOLS = [
    ("astro", ("astro",), _SCRIPT, (Command(("check",), ("typecheck",)), Command(("build",), artifacts=("site",)))),
    ("biome", ("biome",), _SCRIPT, (Command(("check",), ("lint", "format")), Command(("ci",), ("lint", "format")), Command(("lint",), ("lint",)), Command(("format",), ("format",)))),
    ("cargo", ("cargo",), ("rust",), (Command(("test",), ("test",), artifacts=("binary",)), Command(("nextest",), ("test",), artifacts=("binary",)), Command(("clippy",), ("lint",)), Command(("fmt",), ("format",)), Command(("build",), artifacts=("binary",)), Command(("install",), artifacts=("binary",)), Command(("check",)))),
    ("codespell", ("codespell",), (), (Command((), ("lint",)),)),
    ("docker", ("docker",), (), (Command(("build",)),)),
    ("javascript-formatter", ("prettier", "dprint"), _SCRIPT, (Command((), ("format",)),)),
    ("javascript-linter", ("eslint", "oxlint"), _SCRIPT, (Command((), ("lint",)),)),
    ("javascript-package-manager", ("bun", "npm", "pnpm", "yarn"), _SCRIPT, (Command(("test",), ("test",)), Command(("build",), required=("--compile",), artifacts=("binary",)), Command(("build",), required=("--compile=*",), artifacts=("binary",)), Command(("build",), required=("--target", "browser"), rejected=_COMPILE, artifacts=("site",)), Command(("build",), required=("--target=browser*",), rejected=_COMPILE, artifacts=("site",)))),
    ("javascript-test-runner", ("vitest", "jest", "playwright"), _SCRIPT, (Command((), ("test",)),)),
    ("napi", ("napi",), _SCRIPT, (Command(("build",), artifacts=("napi",)),)),
    ("rustfmt", ("rustfmt",), ("rust",), (Command((), ("format",)),)),
    ("site-builder", ("vite", "next", "gatsby"), _SCRIPT, (Command(("build",), artifacts=("site",)),)),
    ("stylelint", ("stylelint",), ("css", "scss", "less"), (Command((), ("lint",)),)),
    ("system-package-manager", ("apt", "apt-get"), (), (Command(("install",)),)),
    ("tauri", ("tauri",), ("rust", "typescript"), (Command(("build",), artifacts=("tauri", "site")),)),
    ("typescript", ("tsc", "tsgo", "vue-tsc"), _SCRIPT, (Command((), ("typecheck",)),)),
    ("vale", ("vale",), (), (Command((), ("lint",)),)),
]

# Directories that hold what was made, and the files that tell so (none: always).
TRAVERSAL = {
    ".next": ("package.json",),
    ".turbo": ("package.json",),
    "__pycache__": (),
    "build": ("package.json",),
    "coverage": ("package.json",),
    "dist": ("package.json",),
    "node_modules": (),
    "target": ("Cargo.toml",),
}

# Names that the update service gives to ecosystems.
UPDATERS = {"bun": ("bun",), "cargo": ("cargo",), "npm": ("npm",), "pnpm": ("npm",), "yarn": ("npm",)}


def commands(spark: SparkSession) -> DataFrame:
    """(tool, program, languages, prefix, required, rejected, tasks, artifacts): a row per program and command."""
    rows = [(t, p, list(ls), list(c.prefix), list(c.required), list(c.rejected), list(c.tasks), list(c.artifacts)) for t, ps, ls, cs in TOOLS for p in ps for c in cs]
    text = "array<string>"
    return spark.createDataFrame(rows, f"tool string, program string, languages {text}, prefix {text}, required {text}, rejected {text}, tasks {text}, artifacts {text}")

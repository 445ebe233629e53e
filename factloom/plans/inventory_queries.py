"""Inventory and forge queries over a small tree given as rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions
from ..operators import forge, forge_facts, inventory, selectors
from ..operators.classify import detect_language
from ..shared import cut

TREE = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n[package]\nname = "top"\n[dependencies]\nserde = "=1.0"\nown = { path = "crates/own" }\n',
    "Cargo.lock": "",
    "src/main.rs": "fn main() {}",
    "crates/own/Cargo.toml": '[package]\nname = "own"\n[[bin]]\nname = "own-cli"\n',
    "crates/own/src/lib.rs": "",
    "web/package.json": '{"name": "web", "workspaces": ["packages/*"], "scripts": {"build": "vite build", "ci": "npm run lint && npm run test:unit", "lint": "eslint .", "test:unit": "vitest run"}, "dependencies": {"vite": "5.0.0"}}',
    "web/pnpm-lock.yaml": "",
    "web/src/a.ts": "",
    "web/packages/p/package.json": '{"name": "p"}',
    "bad/package.json": "{",
    ".github/workflows/ci.yml": "on: [push, pull_request]\njobs:\n  test:\n    defaults: {run: {working-directory: web}}\n    steps:\n      - uses: actions/checkout@v4\n      - run: |\n          npm run ci\n          cargo test && cargo fmt --check\n",
    ".github/dependabot.yml": "version: 2\nupdates:\n  - package-ecosystem: cargo\n    directory: /\n    schedule: {interval: weekly}\n",
}


_made: dict[tuple, inventory.Tables] = {}


def _once(spark: SparkSession, tree: str, make: Callable[[], inventory.Tables]) -> inventory.Tables:
    """The tables of a tree, made once an application: they are written, not kept in memory."""
    key = (spark.sparkContext.applicationId, tree)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _inspected(spark: SparkSession, tree: dict[str, str]) -> inventory.Tables:
    rows = [(p, len(t), None, t) for p, t in tree.items()]
    return inventory.inspect(spark.createDataFrame(rows, "path string, size long, head string, text string"))


def tables(spark: SparkSession) -> inventory.Tables:
    return _once(spark, "tree", lambda: _inspected(spark, TREE))


def packages_inventory(spark: SparkSession, _: str) -> DataFrame:
    p = tables(spark)["packages"]
    return p.select("id", "name", "ecosystem", "workspace_root", "lockfile", F.size("dependencies").alias("n_dependencies"), F.size("scripts").alias("n_scripts"))


def package_owners(spark: SparkSession, _: str) -> DataFrame:
    return tables(spark)["owners"]


def package_languages(spark: SparkSession, _: str) -> DataFrame:
    return tables(spark)["package_languages"].select("package", "language", F.array_join("evidence", ",").alias("evidence"))


def projects_inventory(spark: SparkSession, _: str) -> DataFrame:
    return tables(spark)["projects"].select("root", F.array_join("languages", ",").alias("languages"))


def artifacts_inventory(spark: SparkSession, _: str) -> DataFrame:
    return tables(spark)["artifacts"].select("profile", "root", F.array_join("evidence", ",").alias("evidence"))


def inventory_diagnostics(spark: SparkSession, _: str) -> DataFrame:
    return tables(spark)["diagnostics"].select("kind", "path")


def workflow_tasks(spark: SparkSession, _: str) -> DataFrame:
    """Tasks of a workflow, through package scripts."""
    t = tables(spark)
    steps = forge.steps(t["contents"]).filter("run IS NOT NULL").select("path", "job", "step", "workdir", "run")
    scripts = t["packages"].select("root", F.explode("scripts").alias("s")).select("root", "s.name", "s.command")
    found = forge.classify_tools(forge.expand_scripts(forge.commands(steps).drop("run"), scripts))
    key = ["path", "job", "tool", "task"]
    return forge.dedupe_tasks(found, key, ["depth", "step", "segment"]).select(*key, "depth")


def dependency_updates(spark: SparkSession, _: str) -> DataFrame:
    contents = spark.createDataFrame(list(TREE.items()), "path string, text string")
    return forge.dependency_updates(contents).select("path", "ecosystem", F.array_join("directories", ",").alias("directories"), "interval")


CHECKS = """on:
  push:
  pull_request:
    paths: [src/**]
jobs:
  lint:
    name: Lint all
    if: github.actor != 'x'
    needs: [build, setup]
    continue-on-error: "TRUE"
    timeout-minutes: 10
    steps:
      - uses: codespell-project/actions-codespell@v2
      - uses: wagoid/commitlint-github-action@v6
      - run: cog check && cargo clippy
      - {name: at home, run: "cargo test ; npm run ci -- --fast -- now", working-directory: app/parts/one}
  plan:
    outputs: {matrix: x}
    steps: [{run: echo plan}]
  shared: {uses: org/repo/.github/workflows/x.yml@main}
  each: {name: "build ${{ matrix.os }}", steps: [{run: echo}]}
"""
TITLES = """on: {pull_request_target: }
jobs:
  title:
    steps:
      - env: {TITLE: "${{ github.event.pull_request.title }}"}
        run: echo "$TITLE" | grep -E "^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)" || exit 1
      - uses: amannn/action-semantic-pull-request@v5
      - run: commitlint --edit
"""
MERGE = """on: pull_request
jobs:
  merge:
    if: github.actor == 'dependabot[bot]'
    steps:
      - uses: Dependabot/fetch-metadata@v2
      - if: steps.m.outputs.update-type != 'version-update:semver-major'
        run: gh pr merge --auto "$URL"
"""
MORE = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/skip"]\n',
    "Cargo.lock": '[[package]]\nname = "serde_json"\nversion = "1.0.1"\nsource = "registry"\nchecksum = "abc"\n[[package]]\nname = "a"\nversion = "0.1.0"\n',
    "crates/a/Cargo.toml": '[package]\nname = "a"\n[dependencies]\njson = { package = "serde_json", version = "1" }\n',
    "crates/a/src/bin/tool.rs": "fn main() {}",
    "crates/a/src/lib.rs": "pub fn x() {}\n  #[cfg(test)]\nmod tests {}",
    "crates/skip/Cargo.toml": '[package]\nname = "skip"\n',
    "tools/far/Cargo.toml": '[package]\nname = "far"\nworkspace = "../.."\n',
    "tools/lost/Cargo.toml": '[package]\nname = "lost"\nworkspace = "../nowhere"\n',
    "app/package.json": '{"name": "app", "dependencies": {"astro": "4.0.0", "typescript": "5.0.0"}, "scripts": {"ci": "vitest"}}',
    "app/pnpm-workspace.yaml": 'packages:\n  - "parts/*"\n  - "!parts/old"\n  - "none/*"\n',
    "app/pnpm-lock.yaml": "",
    "app/parts/one/package.json": '{"name": "one", "scripts": {"compile": "bun build --compile x.ts", "ci": "jest"}}',
    "app/parts/one/tsconfig.json": "{}",
    "app/parts/one/a.test.js": "import { it } from 'vitest'\nit('x')",
    "app/parts/old/package.json": '{"name": "old"}',
    "desk/package.json": '{"name": "desk", "devDependencies": {"@napi-rs/cli": "2.0.0"}}',
    "desk/src-tauri/tauri.conf.json": "{}",
    "desk/src-tauri/Cargo.toml": '[package]\nname = "desk"\n',
    "desk/src-tauri/src/main.rs": "fn main() {}",
    "CODEOWNERS": "* @org/all\n",
    ".github/CODEOWNERS": "* @org/team\n/docs/ @x # note\nbad[ @y\n",
    ".github/workflows/check.yml": CHECKS,
    ".github/workflows/title.yaml": TITLES,
    ".github/workflows/merge.yml": MERGE,
    ".github/workflows/broken.yml": "on: [\n",
    ".github/dependabot.yml": "version: 2\nupdates: []\n",
    ".github/dependabot.yaml": "version: 2\nupdates:\n  - {package-ecosystem: npm, directories: [/b, /a, /b], schedule: {interval: daily}}\n",
    "action.yml": "name: My Great Action!\n",
    "README.md": "see https://github.com/marketplace/actions/My-Great-Action",
}


def more(spark: SparkSession) -> inventory.Tables:
    return _once(spark, "more", lambda: _inspected(spark, MORE))


def facts(spark: SparkSession) -> inventory.Tables:
    return _once(spark, "facts", lambda: {k: cut(v, k) for k, v in forge_facts.inspect(more(spark)).items()})


def _steps(spark: SparkSession) -> DataFrame:
    return forge.steps(spark.createDataFrame(list(MORE.items()), "path string, text string"))


def workspace_members(spark: SparkSession, _: str) -> DataFrame:
    return more(spark)["packages"].select("id", "workspace_root", "ecosystem", "lockfile")


def cargo_resolutions(spark: SparkSession, _: str) -> DataFrame:
    return more(spark)["resolutions"]


def workspace_diagnostics(spark: SparkSession, _: str) -> DataFrame:
    return more(spark)["diagnostics"].select("kind", "path", "message")


def project_facets(spark: SparkSession, _: str) -> DataFrame:
    join = lambda c: F.array_join(c, ",").alias(c)
    return more(spark)["projects"].select("root", *[join(c) for c in ("packages", "languages", "ecosystems", "facets")])


def facet_artifacts(spark: SparkSession, _: str) -> DataFrame:
    return more(spark)["artifacts"].select("profile", "root", F.array_join("evidence", ",").alias("evidence"))


def project_languages(spark: SparkSession, _: str) -> DataFrame:
    return more(spark)["package_languages"].select("package", "language", F.array_join("evidence", ",").alias("evidence"))


def package_predicates(spark: SparkSession, _: str) -> DataFrame:
    p = more(spark)["packages"]
    return p.select("id", selectors.depends_on("serde_json").alias("uses_json"), selectors.uses_ecosystem("pnpm").alias("uses_pnpm"), selectors.script("ci").alias("ci"))


def inventory_selections(spark: SparkSession, _: str) -> DataFrame:
    """(question, answer) of the selections."""
    t = more(spark)
    asked = {
        "file": selectors.file(t, "README.md").select("path"),
        "package": selectors.package(t, "cargo:crates/a").select("root"),
        "packages_at": selectors.packages_at(t, "desk").select("id"),
        "project": selectors.project(t, "app").select("root"),
        "workspace": selectors.workspace(t, "").select(F.array_join("member_ids", ",")),
        "artifacts_at": selectors.artifacts_at(t, "desk").select("profile"),
        "artifacts_with_profile": selectors.artifacts_with_profile(t, "site").select("root"),
        "files_with_language": selectors.files_with_language(t, "rust").select("path"),
        "files_for_package": selectors.files_for_package(t, "node:app/parts/one").select("path"),
        "package_owners": selectors.package_owners(t, "desk/src-tauri/src/main.rs").select("id"),
        "has_language": selectors.has_language(t, "typescript").select("id"),
        "has_facet": t["projects"].filter(selectors.has_facet("tauri")).select("root"),
    }
    rows = [df.toDF("answer").select(F.lit(q).alias("question"), "answer") for q, df in asked.items()]
    return reduce(DataFrame.unionByName, rows)


def inline_tests(spark: SparkSession, _: str) -> DataFrame:
    files = detect_language(spark.createDataFrame(list(MORE.items()), "path string, text string"))
    return files.withColumn("mark", selectors.inline_test(F.col("language"), F.col("text"))).filter("mark IS NOT NULL").select("path", "mark")


def language_overlays(spark: SparkSession, _: str) -> DataFrame:
    """Of a few files whether TypeScript detects, accepts and supersedes them."""
    files = detect_language(spark.createDataFrame([(p,) for p in ("a.ts", "b.js", "c.MJS", "d.rs", "e")], "path string"))
    ts = "typescript"
    return files.select("path", selectors.detects_source(ts, F.col("path")).alias("detects"), selectors.accepts_source(ts, F.col("path")).alias("accepts"), F.coalesce(selectors.supersedes(ts, F.col("language")), F.lit(False)).alias("supersedes"))


def style_hosts(spark: SparkSession, _: str) -> DataFrame:
    return selectors.with_facet(dimensions.languages(spark).select("language"), "style-host")


def codeowners_scan(spark: SparkSession, _: str) -> DataFrame:
    return facts(spark)["codeowners_rules"].select("path", "line_no", "pattern", F.array_join("owners", " ").alias("owners"))


def forge_diagnostics(spark: SparkSession, _: str) -> DataFrame:
    return facts(spark)["diagnostics"].select("path", "line_no", F.col("message").startswith("unsupported").alias("pattern"))


def workflow_jobs(spark: SparkSession, _: str) -> DataFrame:
    j = forge_facts.jobs(_steps(spark))
    return j.select("path", "job", "name", "condition", F.array_join("needs", ",").alias("needs"), "has_outputs", "job_continues", "timeout", "job_uses", "n_steps")


def workflow_triggers(spark: SparkSession, _: str) -> DataFrame:
    return forge_facts.workflows(_steps(spark)).select("path", F.array_join("triggers", ",").alias("triggers"), "path_filters", "runs_on_changes")


def pull_request_checks(spark: SparkSession, _: str) -> DataFrame:
    return forge.pull_request_jobs(_steps(spark))


def command_roots(spark: SparkSession, _: str) -> DataFrame:
    c = facts(spark)["commands"].filter("path LIKE '%check.yml' AND job = 'lint'")
    return c.select("step", "segment", "depth", "program", F.array_join("arguments", " ").alias("arguments"), F.array_join("package_roots", ",").alias("package_roots"))


def tool_invocations(spark: SparkSession, _: str) -> DataFrame:
    return facts(spark)["tool_invocations"]


def commit_enforcements(spark: SparkSession, _: str) -> DataFrame:
    return facts(spark)["enforcements"]


def automerge_facts(spark: SparkSession, _: str) -> DataFrame:
    return forge_facts.automerge(_steps(spark))


def action_publication(spark: SparkSession, _: str) -> DataFrame:
    t = spark.createDataFrame(list(MORE.items()), "path string, text string")
    odd = spark.createDataFrame([("x/action.yml", "name: '!!'"), ("y/action.yml", "[")], "path string, text string")
    return forge_facts.publications(t.filter("path = 'action.yml'").unionByName(odd), t.filter("path = 'README.md'")).select("path", "name", "slug", "url", "readme_path", "linked", F.col("error").isNotNull().alias("bad"))


def updater_ecosystems(spark: SparkSession, _: str) -> DataFrame:
    t = spark.createDataFrame(list(MORE.items()), "path string, text string")
    found = forge.dependency_updates(t)
    served = forge_facts.accepted_updaters(found.filter("error IS NULL")).select("path", "ecosystem", F.array_join("directories", ",").alias("directories"), "serves", F.lit(False).alias("bad"))
    return served.unionByName(found.filter("error IS NOT NULL").select("path", "ecosystem", F.array_join("directories", ",").alias("directories"), F.lit(None).cast("string").alias("serves"), F.lit(True).alias("bad")))


SETTINGS = ["version: 2", "version: 1\nupdates: []", "version: 2\nupdates: [x]", "version: 2\nupdates:\n  - {package-ecosystem: npm, directory: /, directories: [/a], schedule: {interval: daily}}", "version: 2\nupdates:\n  - {package-ecosystem: npm, directories: [1], schedule: {interval: daily}}",
            "version: 2\nupdates:\n  - {package-ecosystem: npm, directory: /, schedule: {interval: daily}}\n  - {package-ecosystem: ' ', directory: /, schedule: {interval: daily}}", "version: 2\nupdates:\n  - {package-ecosystem: npm, directory: /}", "version: 2\nupdates:\n  - {package-ecosystem: npm, schedule: {interval: daily}}"]


def update_errors(spark: SparkSession, _: str) -> DataFrame:
    """What is wrong with each of a few settings files."""
    rows = [df.select(F.lit(i).alias("n"), "ecosystem", "error") for i, t in enumerate(SETTINGS) for df in [forge.dependency_updates(spark.createDataFrame([(".github/dependabot.yml", t)], "path string, text string"))]]
    return reduce(DataFrame.unionByName, rows)


def managed_workflows(spark: SparkSession, _: str) -> DataFrame:
    rows = [("dynamic/pages/x", "active", "branch", ["pull_request"]), (".github/workflows/a.yml", "active", "tag", ["pull_request"]), ("b", "disabled", "branch", ["required_status_checks"]), ("c", "active", "branch", ["deletion", "required_status_checks"])]
    t = spark.createDataFrame(rows, "path string, enforcement string, target string, rules array<string>")
    return t.select("path", forge_facts.is_managed(F.col("path")).alias("managed"), forge.is_gating_ruleset(F.col("enforcement"), F.col("target"), F.col("rules")).alias("gating"))


MORE_QUERIES = (workspace_members, cargo_resolutions, workspace_diagnostics, project_facets, facet_artifacts, project_languages, package_predicates, inventory_selections, inline_tests, language_overlays, style_hosts, codeowners_scan, forge_diagnostics, workflow_jobs, workflow_triggers, pull_request_checks, command_roots, tool_invocations, commit_enforcements, automerge_facts, action_publication, updater_ecosystems, update_errors, managed_workflows)
QUERIES = {f.__name__: f for f in (*MORE_QUERIES, packages_inventory, package_owners, package_languages, projects_inventory, artifacts_inventory, inventory_diagnostics, workflow_tasks, dependency_updates)}

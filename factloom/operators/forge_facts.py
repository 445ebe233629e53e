"""What a forge's files say together: owners, tools, commit rules, automatic merges, publications; all of it by `inspect`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions
from ..functions.text import slug
from . import forge
from .classify import action_pin, codeowners
from .idioms import ancestors

Tables = dict[str, DataFrame]
# Where ownership files stand, the first that is there counts; and the forge's limit in bytes.
OWNER_FILES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")
OWNER_LIMIT = 3 * 1024 * 1024
# Actions that run a tool.
TOOL_ACTIONS = (("codespell", "codespell-project/actions-codespell"), ("vale", "errata-ai/vale-action"))
# Id, target, actions, commands (program, first arguments; none: any).
ENFORCERS = (
    ("cocogitto", "commit-message", ("cocogitto/cocogitto-action",), (("cog", ("check", "verify")), ("cocogitto", ("check", "verify")))),
    ("commitlint", "commit-message", ("wagoid/commitlint-github-action",), (("commitlint", ()),)),
    ("convco", "commit-message", (), (("convco", ("check",)),)),
    ("semantic-pull-request", "pull-request-title", ("amannn/action-semantic-pull-request", "step-security/action-semantic-pull-request"), ()),
)
# What a hand-written check of a pull request's title holds: source, kinds of commits, a test, a failure.
TITLE_CHECK = ("conventional-pr-title-pattern", "pull-request-title", "github.event.pull_request.title", "feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert", ("grep", "=~"), ("exit 1", "||"))


def owner_files(files: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ownership files, rules, diagnostics): the first location that is there is read, unless it is over the limit."""
    ranks = F.broadcast(files.sparkSession.createDataFrame(list(enumerate(OWNER_FILES)), "rank int, path string"))
    there = files.join(ranks, "path").select("path", "size", "rank")
    chosen = there.agg(F.min_by(F.struct("path", "size"), "rank").alias("f")).filter("f IS NOT NULL").select("f.*")
    fits = chosen.filter(F.coalesce("size", F.lit(0)) <= OWNER_LIMIT)
    rules, odd = codeowners(contents.join(F.broadcast(fits.select("path")), "path", "left_semi"))
    large = chosen.filter(F.col("size") > OWNER_LIMIT).select("path", F.lit(None).cast("int").alias("line_no"), F.lit("the file is over the size limit").alias("message"))
    return there.select("path"), rules, odd.unionByName(large)


def jobs(steps: DataFrame) -> DataFrame:
    """A row per job of every workflow."""
    about = ["path", "job", "job_order", "condition", "needs", "has_outputs", "job_continues", "timeout", "job_uses"]
    named = F.coalesce("job_name", "job").alias("name")
    return steps.filter("job IS NOT NULL").groupBy(*about, named).agg(F.count("step").alias("n_steps"))


def workflows(steps: DataFrame) -> DataFrame:
    """A row per readable workflow: triggers, whether it runs on changes, whether pull requests filter by path."""
    ok = steps.filter("error IS NULL").select("path", "triggers", "path_filters").distinct()
    return ok.withColumn("runs_on_changes", forge.runs_on_changes(F.col("triggers")))


def label(steps: DataFrame) -> Column:
    """What a step is called."""
    return F.coalesce("name", "run", "uses", F.lit("unnamed step"))


def package_roots(commands: DataFrame, packages: DataFrame, members: DataFrame, workspaces: DataFrame) -> DataFrame:
    """`commands` (workdir, program, depth) with package_roots.

    A script's command belongs to the script's package; cargo at the root of a workspace to all its members and its own
    package; any other to the nearest package of the working directory.
    """
    key = commands.columns
    inside = members.join(packages.filter("kind = 'cargo'").select("id", "root"), "id").select(F.col("workspace_root").alias("workdir"), "root")
    whole = workspaces.filter("kind = 'cargo'").select(F.col("root").alias("workdir"))
    own = packages.filter("kind = 'cargo'").select(F.col("root").alias("workdir"), "root")
    cargo = inside.unionByName(own).join(whole.distinct(), "workdir", "left_semi").groupBy("workdir").agg(F.array_sort(F.collect_set("root")).alias("all_roots"))
    places = commands.select("workdir").distinct()
    up = places.select("workdir", F.explode(ancestors(F.col("workdir"))).alias("a")).select("workdir", F.col("a.root").alias("root"), F.col("a.depth").alias("d"))
    near = up.join(packages.select("root").distinct(), "root").groupBy("workdir").agg(F.max_by("root", "d").alias("near"))
    whole_roots = whole.distinct().join(cargo, "workdir", "left").withColumn("is_whole", F.lit(True))
    out = commands.join(F.broadcast(whole_roots), "workdir", "left").join(near, "workdir", "left")
    none = F.array().cast("array<string>")
    roots = F.when(F.col("depth") > 0, F.array("workdir")).when((F.col("program") == "cargo") & F.col("is_whole"), F.coalesce("all_roots", none)).when(F.col("near").isNotNull(), F.array("near")).otherwise(none)
    return out.select(*key, roots.alias("package_roots"))


def action_of(uses: Column) -> Column:
    """The action of a step, without its version: what is before the first @."""
    return F.substring_index(uses, "@", 1)


def tool_invocations(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """(tool, path, job, step, source, runs_on_changes): tools that commands and actions run, each once."""
    spark = steps.sparkSession
    known = F.broadcast(spark.createDataFrame([(t, a.lower()) for t, a in TOOL_ACTIONS], "tool string, action string"))
    acts = steps.filter("uses IS NOT NULL").withColumn("action", F.lower(action_of(F.col("uses")))).join(known, "action").select("tool", "path", "job", "step", F.lit("github-action").alias("source"))
    cmds = tasks.select("tool", "path", "job", "step", F.lit("command").alias("source"))
    return acts.unionByName(cmds).distinct().join(workflows(steps).select("path", "runs_on_changes"), "path").select("tool", "path", "job", "step", "source", "runs_on_changes")


def enforcements(steps: DataFrame, commands: DataFrame) -> DataFrame:
    """(path, job, step, enforcer, target): where the form of commit messages or titles is enforced, each once.

    Titles count in workflows that pull requests trigger, messages in those that run on changes.
    """
    spark = steps.sparkSession
    acts = F.broadcast(spark.createDataFrame([(i, t, a) for i, t, actions, _ in ENFORCERS for a in actions], "enforcer string, target string, action string"))
    progs = F.broadcast(spark.createDataFrame([(i, t, p, list(subs)) for i, t, _, cs in ENFORCERS for p, subs in cs], "enforcer string, target string, program string, subs array<string>"))
    at = ["path", "job", "step", "enforcer", "target"]
    by_action = steps.withColumn("action", action_of(F.col("uses"))).join(acts, "action").select(*at)
    name, target, source, kinds, tests, failures = TITLE_CHECK
    holds = lambda *words: F.array_max(F.array(*[F.col("run").contains(w) for w in words]))
    reads = F.col("run").contains(source) | F.exists("env", lambda e: e["value"].contains(source))
    by_title = steps.filter(reads & F.col("run").contains(kinds) & holds(*tests) & holds(*failures)).withColumns({"enforcer": F.lit(name), "target": F.lit(target)}).select(*at)
    fits = (F.size("subs") == 0) | F.array_contains("subs", F.get("arguments", F.lit(0)))
    by_command = commands.join(progs, "program").filter(fits).select(*at)
    on = steps.select("path", "triggers").distinct()
    pull = F.arrays_overlap("triggers", F.array(F.lit("pull_request"), F.lit("pull_request_target")))
    wanted = F.when(F.col("target") == "pull-request-title", pull).otherwise(forge.runs_on_changes(F.col("triggers")))
    return by_action.unionByName(by_title).unionByName(by_command).join(on, "path").filter(wanted).select(*at).distinct()


def automerge(steps: DataFrame) -> DataFrame:
    """Per workflow whether updates merge by themselves, and what guards it: five booleans over all jobs and steps."""
    said = lambda c: F.lower(F.coalesce(c, F.lit("")))
    job, step, run = said("condition"), said("step_condition"), said("run")
    either = lambda test: test(job) | test(step)
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return steps.filter("error IS NULL").groupBy("path").agg(
        any_of(F.arrays_overlap("triggers", F.array(F.lit("pull_request"), F.lit("pull_request_target")))).alias("pull_request_trigger"),
        any_of(either(lambda c: c.contains("dependabot[bot]"))).alias("dependabot_only"),
        any_of(either(lambda c: c.contains("update-type") & c.contains("semver-major") & c.contains("!="))).alias("excludes_major_updates"),
        any_of(F.lower(action_of(F.col("uses"))) == "dependabot/fetch-metadata").alias("fetches_metadata"),
        any_of(run.contains("gh pr merge") & run.contains("--auto") | run.contains("enablepullrequestautomerge")).alias("enables_auto_merge"),
    )


def _action_name(text: str | None) -> str | None:
    try:
        doc = forge._loader()(text)
        return doc["name"] if isinstance(doc, dict) and isinstance(doc.get("name"), str) else None
    except Exception:  # a manifest that can't be read has no name
        return None


def publications(manifests: DataFrame, readmes: DataFrame) -> DataFrame:
    """(path, name, slug, url, readme_path, linked, error) of action manifests (path, text) and at most one readme (path, text)."""
    named = manifests.select("path", F.udf(_action_name, "string", useArrow=True)("text").alias("name"))
    made = slug(F.col("name"))
    rows = named.withColumn("slug", F.when(made != "", made)).withColumn("url", F.concat(F.lit("https://github.com/marketplace/actions/"), "slug"))
    readme = F.broadcast(readmes.select(F.col("path").alias("readme_path"), F.lower("text").alias("__readme")).limit(1))
    error = F.when(F.col("name").isNull(), "the manifest has no readable name").when(F.col("slug").isNull(), "the name can't form an address")
    out = rows.join(readme, F.lit(True), "left")  # one row on the right at most
    return out.select("path", "name", "slug", "url", "readme_path", F.coalesce(F.col("__readme").contains(F.col("url")), F.lit(False)).alias("linked"), error.alias("error"))


def accepted_updaters(updates: DataFrame) -> DataFrame:
    """`updates` (ecosystem: the update service's name) with `serves`, the ecosystem of ours that the name stands for; a row each."""
    extra = {"bun": ("npm",)}  # fixed values: names that are taken as well
    rows = [(e, n) for e, names in dimensions.UPDATERS.items() for n in (*names, *extra.get(e, ()))]
    known = F.broadcast(updates.sparkSession.createDataFrame(rows, "serves string, ecosystem string"))
    return updates.join(known, "ecosystem")


def has_task(tasks: DataFrame, steps: DataFrame, language: str, task: str) -> DataFrame:
    """(path): workflows that run on changes and do `task` for `language`."""
    live = workflows(steps).filter("runs_on_changes").select("path")
    return tasks.filter((F.col("task") == task) & applies_to(language)).join(live, "path", "left_semi").select("path").distinct()


def runs_tool(invocations: DataFrame, tool: str) -> DataFrame:
    """(path): workflows that run on changes and run `tool`."""
    return invocations.filter((F.col("tool") == tool) & F.col("runs_on_changes")).select("path").distinct()


def applies_to(language: str) -> Column:
    return F.array_contains("languages", language)


def produces(artifact: str) -> Column:
    return F.array_contains("artifacts", artifact)


def is_managed(path: Column) -> Column:
    """Whether the forge itself made a workflow."""
    return path.startswith("dynamic/")


def inspect(tables: Tables) -> Tables:
    """All facts of the forge, from the tables of `inventory.inspect`."""
    contents, packages = tables["contents"], tables["packages"]
    steps = forge.steps(contents)
    named, rules, odd = owner_files(tables["files"], contents)
    scripts = packages.select("root", F.explode("scripts").alias("s")).select("root", "s.name", "s.command")
    runs = steps.filter("run IS NOT NULL").select("path", "job", "step", "workdir", "run")
    commands = forge.expand_scripts(forge.commands(runs).drop("run"), scripts)
    commands = package_roots(commands, packages, tables["members"], tables["workspaces"])
    tasks = forge.classify_tools(commands)
    key = ["path", "job", "step", "tool", "task", "program", "arguments", "workdir", "package_roots", "artifacts"]
    tasks = forge.dedupe_tasks(tasks, key, ["depth", "segment"])
    broken = steps.filter("error IS NOT NULL").select("path", F.lit(None).cast("int").alias("line_no"), F.col("error").alias("message"))
    return {
        "codeowners_files": named,
        "codeowners_rules": rules,
        "updates": forge.dependency_updates(contents),
        "workflows": workflows(steps),
        "jobs": jobs(steps),
        "steps": steps,
        "commands": commands,
        "tasks": tasks,
        "tool_invocations": tool_invocations(steps, tasks),
        "enforcements": enforcements(steps, commands),
        "automerge": automerge(steps),
        "action_references": steps.filter("uses IS NOT NULL").select("path", "job", "step", action_pin(F.col("uses")).alias("p")).select("path", "job", "step", "p.*"),
        "diagnostics": odd.unionByName(broken),
    }

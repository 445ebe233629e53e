"""Facts of a code forge: workflows, commands, tasks, expanded scripts, update settings."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import dimensions
from ..shared import cut
from .classify import normalize_invocation, script_kind
from .idioms import ancestors

#: Triggers by which a workflow runs on changes.
CHANGES = ("push", "pull_request")
MAX_DEPTH = 8
SEPARATORS = ("&&", "||", ";", "|")
_PAIRS = "array<struct<name:string,value:string>>"
STEP = (
    "path string, triggers array<string>, path_filters boolean, job string, job_name string, job_order int, condition string, needs array<string>, has_outputs boolean, job_continues boolean, timeout string, job_uses string, "
    f"step int, name string, uses string, run string, workdir string, shell string, step_condition string, step_continues boolean, inputs {_PAIRS}, env {_PAIRS}, error string"
)


def _loader():
    """YAML 1.2 scalars: on, off, yes and no are words; a repeated key is an error."""
    import re

    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) != len(keys):
            raise yaml.YAMLError("repeated key")
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Loader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: mapping(loader, node, True))
    return lambda text: yaml.load(text, Loader)  # noqa: S506 - a safe loader


def scalar_text(value: object) -> str | None:
    """A string or number as text; nothing else has one, booleans neither."""
    return None if isinstance(value, bool) or not isinstance(value, str | int | float) else str(value)


def triggers(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    return sorted({x for x in (value.keys() if isinstance(value, dict) else value if isinstance(value, list) else []) if isinstance(x, str)})


def text_only(value: object) -> str | None:
    return value if isinstance(value, str) else None


def is_true(value: object) -> bool:
    """A true boolean, or its word in any case."""
    return value is True or isinstance(value, str) and value.strip().lower() == "true"


def has_values(value: object) -> bool:
    """Whether a field says anything: numbers do, empty text, lists and mappings don't."""
    return bool(value) or isinstance(value, int | float) and not isinstance(value, bool)


def string_set(value: object) -> list[str]:
    return [value] if isinstance(value, str) else sorted({x for x in value if isinstance(x, str)}) if isinstance(value, list) else []


def path_filters(on: object) -> bool:
    """Whether pull requests trigger by path."""
    pull = on.get("pull_request") if isinstance(on, dict) else None
    return isinstance(pull, dict) and any(has_values(pull.get(k)) for k in ("paths", "paths-ignore"))


def workdir(*candidates: object) -> str:
    """The first usable of step and job settings: relative, inside, not computed."""
    for c in candidates:
        if isinstance(c, str) and "${{" not in c and not c.startswith("/") and ".." not in c.split("/"):
            return "/".join(x for x in c.split("/") if x not in ("", "."))
    return ""


def _default(job: dict) -> object:
    run = (job.get("defaults") if isinstance(job.get("defaults"), dict) else {}).get("run")
    return run.get("working-directory") if isinstance(run, dict) else None


def _pairs(value: object) -> list[tuple[str, str]]:
    return [(k, scalar_text(v)) for k, v in value.items() if isinstance(k, str) and scalar_text(v) is not None] if isinstance(value, dict) else []


def _workflow_rows(path: str, doc: dict) -> list[dict]:
    """A row a step, or a job without steps, or a workflow without jobs."""
    on = doc.get("on")
    head = {"path": path, "triggers": triggers(on), "path_filters": path_filters(on)}
    rows, jobs = [], doc.get("jobs")
    for j, (job, spec) in enumerate((jobs if isinstance(jobs, dict) else {}).items()):
        if not isinstance(job, str) or not isinstance(spec, dict):
            continue
        about = head | {
            "job": job, "job_name": text_only(spec.get("name")), "job_order": j, "condition": scalar_text(spec.get("if")), "needs": string_set(spec.get("needs")), "has_outputs": has_values(spec.get("outputs")),
            "job_continues": is_true(spec.get("continue-on-error")), "timeout": scalar_text(spec.get("timeout-minutes")), "job_uses": text_only(spec.get("uses")),
        }
        listed = spec.get("steps") if isinstance(spec.get("steps"), list) else []
        made = [
            about | {
                "step": i, "name": text_only(s.get("name")), "uses": text_only(s.get("uses")), "run": text_only(s.get("run")), "workdir": workdir(s.get("working-directory"), _default(spec)), "shell": scalar_text(s.get("shell")),
                "step_condition": text_only(s.get("if")), "step_continues": is_true(s.get("continue-on-error")), "inputs": _pairs(s.get("with")), "env": _pairs(s.get("env")),
            }
            for i, s in enumerate(listed)
            if isinstance(s, dict)
        ]
        rows += made or [about]
    return rows or [head]


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    load = _loader()
    names = [x.split()[0] for x in STEP.split(", ")]
    lists = {"triggers", "needs", "inputs", "env"}
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            try:
                doc = load(text)
                if not isinstance(doc, dict):
                    raise ValueError("not a mapping")
                rows += _workflow_rows(path, doc)
            except Exception as e:  # a broken file is a row
                rows.append({"path": path, "error": str(e)[:200]})
        yield pd.DataFrame([[r.get(n, [] if n in lists else None) for n in names] for r in rows], columns=names).astype({"step": "Int64", "job_order": "Int64"})


def is_workflow(path: Column) -> Column:
    return path.rlike(r"^\.github/workflows/.*\.ya?ml$")


def steps(contents: DataFrame) -> DataFrame:
    """A row per step of every workflow of `contents` (path, text); a broken file is a row with an error."""
    return contents.filter(is_workflow(F.col("path"))).select("path", "text").mapInPandas(_steps, STEP)


def runs_on_changes(on: Column) -> Column:
    return F.arrays_overlap(on, F.array(*map(F.lit, CHANGES)))


def pull_request_jobs(steps_: DataFrame) -> DataFrame:
    """(path, job): names that pull requests show, without computed ones and jobs with outputs."""
    named = F.coalesce("job_name", "job")
    return steps_.filter(F.array_contains("triggers", "pull_request") & F.col("job").isNotNull() & ~F.col("has_outputs") & ~named.contains("${{")).select("path", named.alias("job")).distinct()


def segments(script: str | None) -> list[list[str]]:
    """The commands of a script: lines split like a shell does, cut at separators that stand alone."""
    out: list[list[str]] = []
    for line in (script or "").splitlines():
        try:
            words = shlex.split(line, comments=True)
        except ValueError:
            continue
        now: list[str] = []
        for w in [*words, ";"]:
            if w in SEPARATORS:
                if now:
                    out.append(now)
                now = []
            else:
                now.append(w)
    return out


_segments = F.udf(segments, ArrayType(ArrayType(StringType())), useArrow=True)


def commands(rows: DataFrame, script: str = "run") -> DataFrame:
    """`rows` with segment, program and arguments: one row a command."""
    cut = rows.select("*", F.posexplode(_segments(script)).alias("segment", "__words"))
    return cut.withColumn("__i", normalize_invocation(F.col("__words"))).filter("__i IS NOT NULL").select(*rows.columns, "segment", F.col("__i.program").alias("program"), F.col("__i.arguments").alias("arguments"))


def classify_tools(cmds: DataFrame) -> DataFrame:
    """`cmds` with tool, task, languages and artifacts, for every pattern that a command fits."""
    spark = cmds.sparkSession
    known = F.broadcast(dimensions.commands(spark))
    args = F.col("arguments")
    fits = lambda want: lambda a: F.when(want.endswith("*"), a.startswith(F.rtrim(want, F.lit("*")))).otherwise(a == want)
    ok = (
        (F.slice(args, F.lit(1), F.size("prefix")) == F.col("prefix"))
        & F.forall("required", lambda w: F.exists(args, fits(w)))
        & F.forall("rejected", lambda w: ~F.exists(args, fits(w)))
    )
    return cmds.join(known, "program").filter(ok).select(*cmds.columns, "tool", "languages", F.explode("tasks").alias("task"), "artifacts")


def expand_scripts(cmds: DataFrame, scripts: DataFrame) -> DataFrame:
    """`cmds` (key, workdir, program, arguments) and the commands of package scripts that they run, with depth.

    scripts: (root, name, command). Levels 0 to MAX_DEPTH run; a script that is already on the way isn't entered again.
    """
    runner = F.col("program").isin("npm", "pnpm", "yarn", "bun")
    skip = F.when((F.get("arguments", F.lit(0)) == "run") & (F.size("arguments") > 1), 2).otherwise(1)
    name = F.get("arguments", skip - 1)
    roots = scripts.select("root").distinct()
    level = cut(cmds, "commands").withColumn("depth", F.lit(0)).withColumn("seen", F.array().cast("array<string>"))
    out = level
    for depth in range(1, MAX_DEPTH + 1):
        calls = level.filter(runner).withColumn("__name", name).filter("__name IS NOT NULL")
        up = calls.select("*", F.explode(ancestors(F.col("workdir"))).alias("__a")).join(roots, F.col("__a.root") == F.col("root"))
        near = up.groupBy(*[c for c in calls.columns]).agg(F.max_by("root", F.col("__a.depth")).alias("root"))
        found = near.join(scripts.select("root", F.col("name").alias("__name"), "command"), ["root", "__name"])
        mark = F.concat_ws("\0", "root", "__name")
        fresh = found.withColumn("__mark", mark).filter(~F.array_contains("seen", F.col("__mark")))
        rest = F.slice("arguments", skip + 1, F.greatest(F.size("arguments") - skip, F.lit(0)))
        # Of what is handed on, a first -- only tells where it begins.
        rest = F.when(F.get(rest, F.lit(0)) == "--", F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        text = F.concat_ws(" ", "command", F.array_join(rest, " "))
        base = fresh.select(*[c for c in cmds.columns if c not in ("workdir", "program", "arguments", "segment")], F.col("root").alias("workdir"), F.trim(text).alias("__script"), F.array_append("seen", F.col("__mark")).alias("seen"))
        level = cut(commands(base, "__script").drop("__script").withColumn("depth", F.lit(depth)).select(*out.columns), "scripts")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def dedupe_tasks(tasks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by the order in which tasks were met."""
    w = Window.partitionBy(*key).orderBy(*order)
    return tasks.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def script_tasks(scripts: DataFrame) -> DataFrame:
    """(root, name, task): what the names of scripts say."""
    return scripts.select("root", "name", script_kind(F.col("name")).alias("task")).filter("task IS NOT NULL")


UPDATE = "path string, ecosystem string, directories array<string>, interval string, error string"


def _said(value: object) -> bool:
    return isinstance(value, str) and bool(value.strip())


def update(entry: object, number: int) -> tuple[str, list[str], str]:
    """(ecosystem, folders, interval) of one update setting; whatever it lacks raises."""
    if not isinstance(entry, dict):
        raise ValueError(f"update {number} must be a mapping")
    one, many, schedule = entry.get("directory"), entry.get("directories"), entry.get("schedule")
    every = schedule.get("interval") if isinstance(schedule, dict) else None
    folders = many if isinstance(many, list) else [one]
    lacks = {
        "an ecosystem": not _said(entry.get("package-ecosystem")),
        "a directory or directories, not both": "directory" in entry and "directories" in entry,
        "a list of directories": "directories" in entry and not isinstance(many, list),
        "directories that are texts": not folders or not all(map(_said, folders)),
        "a schedule with an interval": not _said(every),
    }
    if any(lacks.values()):
        raise ValueError(f"update {number} needs {next(k for k, v in lacks.items() if v)}")
    return entry["package-ecosystem"], sorted(set(folders)), every


def _updates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    load = _loader()
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            try:
                doc = load(text)
                if not isinstance(doc, dict) or doc.get("version") != 2:
                    raise ValueError("version must be 2")
                if not isinstance(doc.get("updates"), list):
                    raise ValueError("a list of updates is due")
                rows += [[path, *update(u, i + 1), None] for i, u in enumerate(doc["updates"])]
            except Exception as e:  # the first error ends the file
                rows.append([path, None, [], None, str(e)[:200]])
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in UPDATE.split(", ")])


def dependency_updates(contents: DataFrame) -> DataFrame:
    """Update settings of `.github/dependabot.yaml` or `.yml`, the first by name; a row with an error if both are there."""
    own = contents.filter(F.col("path").rlike(r"^\.github/dependabot\.ya?ml$"))
    first = own.agg(F.min_by(F.struct("path", "text"), "path").alias("f"), F.count("*").alias("n")).filter("f IS NOT NULL")
    none = [F.lit(None).cast("string").alias("ecosystem"), F.array().cast("array<string>").alias("directories"), F.lit(None).cast("string").alias("interval")]
    both = first.filter("n > 1").select("f.path", *none, F.lit("two configuration files, of which the first is read").alias("error"))
    return first.select("f.*").mapInPandas(_updates, UPDATE).unionByName(both)


def is_gating_ruleset(enforcement: Column, target: Column, rules: Column) -> Column:
    """Whether a rule set is active for branches and asks for checks or reviews."""
    return (enforcement == "active") & (target == "branch") & F.arrays_overlap(rules, F.array(F.lit("required_status_checks"), F.lit("pull_request")))


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))



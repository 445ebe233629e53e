"""Inventory of a code base: manifests, packages, ecosystems, workspaces, ownership, projects, artifacts.

Every stage takes and returns named tables; failures are rows of `diagnostics`. Manifests are parsed by
Arrow batches (TOML and JSON have no native reader for fields of free names); all that follows is joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions
from ..shared import cut
from ..sources.tree import glob_regex
from .classify import basename, detect_language, parent
from .idioms import nearest_owner

Tables = dict[str, DataFrame]
MANIFEST = (
    "root string, path string, kind string, name string, private boolean, declared string, workspace string, is_workspace boolean, "
    "dependencies array<struct<name:string,package:string,kind:string,source:string,requirement:string>>, scripts array<struct<name:string,command:string>>, "
    "members array<string>, excluded array<string>, bins array<string>, error string"
)
_FIELDS = [f.split()[0] for f in MANIFEST.replace("array<struct<name:string,package:string,kind:string,source:string,requirement:string>>", "x").replace("array<struct<name:string,command:string>>", "x").split(", ")]


def cargo_dependency(name: str, kind: str, value: object) -> tuple:
    """(name, package, kind, source, requirement): the first rule that fits."""
    if isinstance(value, str):
        return name, None, kind, "registry", value
    if not isinstance(value, dict):
        return name, None, kind, "unknown", None
    package = value.get("package")
    for key, source in (("workspace", "workspace"), ("path", "local-path")):
        if value.get(key) and (key != "workspace" or value[key] is True):
            return name, package, kind, source, None
    if "git" in value:
        return name, package, kind, "git", value.get("rev")
    return name, package, kind, "registry", value.get("version")


def cargo_manifest(text: str) -> dict:
    import tomllib

    doc = tomllib.loads(text)
    pack, work = doc.get("package") or {}, doc.get("workspace")
    tables = [("runtime", "dependencies"), ("development", "dev-dependencies"), ("build", "build-dependencies")]
    deps = [cargo_dependency(n, k, v) for k, t in tables for d in [doc, *(doc.get("target") or {}).values()] for n, v in (d.get(t) or {}).items()]
    link = pack.get("workspace")
    return {
        "name": pack.get("name") if isinstance(pack.get("name"), str) else None,
        "private": pack.get("publish") is False,
        "workspace": link if isinstance(link, str) else None,
        "is_workspace": work is not None,
        "dependencies": deps,
        "members": list((work or {}).get("members") or []),
        "excluded": list((work or {}).get("exclude") or []),
        "bins": [b["name"] for b in doc.get("bin") or [] if isinstance(b.get("name"), str)],
        "package": bool(pack),
    }


def node_source(requirement: str) -> str:
    if requirement.startswith("workspace:"):
        return "workspace"
    if requirement.startswith(("file:", "link:", "./", "../")):
        return "local-path"
    return "git" if requirement.startswith(("git+", "git:", "github:")) else "registry"


def node_manifest(text: str) -> dict:
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise ValueError("not an object")
    kinds = [("runtime", "dependencies"), ("development", "devDependencies"), ("peer", "peerDependencies"), ("optional", "optionalDependencies")]
    deps = [(n, None, k, node_source(v), v) for k, t in kinds for n, v in (doc.get(t) or {}).items() if isinstance(v, str)]
    work = doc.get("workspaces")
    globs = work.get("packages") if isinstance(work, dict) else work
    globs = [g for g in globs or [] if isinstance(g, str)]
    manager = doc.get("packageManager")
    return {
        "name": doc.get("name") if isinstance(doc.get("name"), str) else None,
        "private": doc.get("private") is True,
        "declared": manager.split("@")[0] if isinstance(manager, str) else None,
        "is_workspace": work is not None,
        "dependencies": deps,
        "scripts": [(n, c) for n, c in (doc.get("scripts") or {}).items() if isinstance(c, str)],
        "members": [g for g in globs if not g.startswith("!")],
        "excluded": [g[1:] for g in globs if g.startswith("!")],
        "package": True,
    }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            kind = "cargo" if path.rsplit("/", 1)[-1] == "Cargo.toml" else "node"
            root = path.rsplit("/", 1)[0] if "/" in path else ""
            row = dict.fromkeys(_FIELDS) | {"root": root, "path": path, "kind": kind, "is_workspace": False, "dependencies": [], "scripts": [], "members": [], "excluded": [], "bins": []}
            try:
                found = (cargo_manifest if kind == "cargo" else node_manifest)(text if text is not None else "\0")
                row |= {k: v for k, v in found.items() if k in row}
                if not found["package"]:
                    row["kind"] = "cargo-virtual"
            except Exception as e:  # any malformed manifest is a row, never a failure
                row["error"] = str(e)[:200]
            rows.append([row[f] for f in _FIELDS])
        yield pd.DataFrame(rows, columns=_FIELDS)


def manifests(files: DataFrame) -> DataFrame:
    """A row per Cargo.toml and package.json of `files` (path, text)."""
    own = files.filter(basename(F.col("path")).isin("Cargo.toml", "package.json"))
    return own.select("path", "text").mapInPandas(_parse, MANIFEST)


def packages(parsed: DataFrame) -> DataFrame:
    ok = parsed.filter("error IS NULL AND kind <> 'cargo-virtual'")
    return ok.withColumn("id", F.concat_ws(":", "kind", F.when(F.col("root") == "", ".").otherwise(F.col("root"))))


def resolve_ecosystems(pkgs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages with ecosystem and ecosystems, diagnostics): lockfiles beside the manifest, else what it declares, else npm."""
    spark = pkgs.sparkSession
    locks = dimensions.ecosystems(spark).filter("ecosystem <> 'cargo'").select("ecosystem", F.explode("lockfiles").alias("__lock"))
    beside = files.select(parent(F.col("path")).alias("root"), basename(F.col("path")).alias("__lock")).join(F.broadcast(locks), "__lock")
    found = beside.groupBy("root").agg(F.array_sort(F.collect_set("ecosystem")).alias("found"))
    known = [e[0] for e in dimensions.ECOSYSTEMS if e[0] != "cargo"]
    node = pkgs.join(found, "root", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    declared = F.when(F.col("declared").isin(*known), F.col("declared"))
    eco = F.when(F.col("kind") == "cargo", F.lit("cargo")).otherwise(F.coalesce(F.get("found", F.lit(0)), declared, F.lit("npm")))
    all_ = F.when(F.col("kind") == "cargo", F.array(F.lit("cargo"))).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(eco), F.col("found")))))
    out = node.withColumn("ecosystem", eco).withColumn("ecosystems", all_)
    is_node = F.col("kind") == "node"
    notes = F.array_compact(
        F.array(
            F.when(is_node & (F.size("found") > 1), F.concat(F.lit("several lockfiles: "), F.array_join("found", ", "))),
            F.when(is_node & F.col("declared").isNotNull() & declared.isNull(), F.concat(F.lit("unknown package manager: "), "declared")),
            F.when(is_node & declared.isNotNull() & (F.size("found") > 0) & (declared != F.get("found", F.lit(0))), F.concat(F.lit("declared "), "declared", F.lit(" but locked by "), F.get("found", F.lit(0)))),
        )
    )
    diagnostics = out.select(F.lit("ecosystem").alias("kind"), "path", F.explode(notes).alias("message"))
    return out.drop("found"), diagnostics


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            root = path.rsplit("/", 1)[0] if "/" in path else ""
            try:
                doc = yaml.safe_load(text)
                listed = doc.get("packages") if isinstance(doc, dict) else None
                globs = [g for g in listed if isinstance(g, str)] if isinstance(listed, list) else []
                rows.append([root, path, [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")], None])
            except Exception as e:  # a broken file is a row
                rows.append([root, path, [], [], str(e)[:200]])
        yield pd.DataFrame(rows, columns=["root", "path", "members", "excluded", "error"])


def pnpm_workspaces(contents: DataFrame, parsed: DataFrame) -> DataFrame:
    """(root, path, members, excluded, error): pattern files that stand beside a readable package.json."""
    beside = parsed.filter("kind = 'node' AND error IS NULL").select("root")
    own = contents.filter(basename(F.col("path")) == "pnpm-workspace.yaml").withColumn("root", parent(F.col("path"))).join(beside, "root", "left_semi")
    return own.select("path", "text").mapInPandas(_patterns, "root string, path string, members array<string>, excluded array<string>, error string")


def workspace_specs(parsed: DataFrame, pnpm: DataFrame | None = None) -> DataFrame:
    """(kind, ws, path, members, excluded): a row a workspace root, the patterns of all its files together."""
    specs = parsed.filter("is_workspace AND error IS NULL").select(F.when(F.col("kind").startswith("cargo"), "cargo").otherwise("node").alias("kind"), F.col("root").alias("ws"), "path", "members", "excluded")
    if pnpm is not None:
        specs = specs.unionByName(pnpm.filter("error IS NULL").select(F.lit("node").alias("kind"), F.col("root").alias("ws"), "path", "members", "excluded"))
    every = lambda c: F.array_distinct(F.array_compact(F.flatten(F.collect_list(c)))).alias(c)
    return specs.groupBy("kind", "ws").agg(F.min("path").alias("path"), every("members"), every("excluded"))


def resolve_workspaces(pkgs: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: package id, workspace root; diagnostics).

    A package that names its workspace belongs to it alone; the others meet the globs of the workspaces over them, by an
    equi-join on ancestors, and the deepest wins.
    """
    from .idioms import ancestors, normalize_relative

    to_regex = F.udf(_regex, "string", useArrow=True)  # one call a pattern, not a row of data
    rx = specs.select("kind", "ws", F.col("members").alias("m"), "excluded")
    inc = rx.select("kind", "ws", F.explode("m").alias("glob")).withColumn("rx", to_regex("glob"))
    exc = rx.select("kind", "ws", F.explode("excluded").alias("glob")).withColumn("rx", to_regex("glob")).filter("rx IS NOT NULL")
    says = F.when(F.col("kind") == "cargo", F.col("workspace"))
    named = pkgs.filter(says.isNotNull()).select("id", "path", normalize_relative(F.col("root"), F.col("workspace")).alias("ws"))
    there = specs.filter("kind = 'cargo'").select("ws", F.lit(True).alias("found"))
    named = named.join(F.broadcast(there), "ws", "left")
    free = pkgs.filter(says.isNull())
    under = pkgs.select("id", "kind", "root", F.explode(ancestors(F.col("root"))).alias("a")).select("id", "kind", "root", F.col("a.root").alias("ws"), F.col("a.depth").alias("depth"))
    own = F.when(F.col("ws") == "", F.col("root")).otherwise(F.substring("root", F.length("ws") + 2, F.lit(1 << 20)))
    near = under.withColumn("rel", own)
    hit = near.join(inc, ["kind", "ws"]).filter(F.expr("rel <> '' AND rel RLIKE rx"))
    out = near.join(exc, ["kind", "ws"]).filter(F.expr("rel RLIKE rx")).select("id", "ws").distinct()
    root_member = near.join(specs.select("kind", "ws"), ["kind", "ws"]).filter("rel = ''").select("id", "ws", "depth")
    members = hit.join(out, ["id", "ws"], "left_anti").select("id", "ws", "depth").unionByName(root_member).join(free.select("id"), "id", "left_semi")
    best = members.groupBy("id").agg(F.max_by("ws", F.struct("depth", "ws")).alias("workspace_root"))
    best = best.unionByName(named.filter("found").select("id", F.col("ws").alias("workspace_root")))
    note = lambda df, path, text: df.select(F.lit("workspace").alias("kind"), F.col(path).alias("path"), text.alias("message"))
    bad = note(inc.filter("rx IS NULL"), "ws", F.concat(F.lit("bad pattern: "), "glob"))
    idle = inc.filter("rx IS NOT NULL").join(hit.select("kind", "ws", "glob").distinct(), ["kind", "ws", "glob"], "left_anti")
    lost = note(named.filter("found IS NULL"), "path", F.concat(F.lit("no workspace at "), "ws"))
    return best, bad.unionByName(note(idle, "ws", F.concat(F.lit("no package matches "), "glob"))).unionByName(lost)


def _regex(glob: str) -> str | None:
    try:
        return "^" + glob_regex(glob.removeprefix("./").rstrip("/")) + "$"
    except ValueError:
        return None


def inherit(pkgs: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Packages with workspace_root, lockfile_owner and lockfile; node members take the ecosystem of their workspace."""
    spark = pkgs.sparkSession
    df = pkgs.join(members, "id", "left").withColumn("lockfile_owner", F.coalesce("workspace_root", "root"))
    owner = pkgs.select(F.col("kind"), F.col("root").alias("lockfile_owner"), F.col("ecosystem").alias("__eco"))
    df = df.join(owner, ["kind", "lockfile_owner"], "left")
    eco = F.when((F.col("kind") == "node") & F.col("__eco").isNotNull(), F.col("__eco")).otherwise(F.col("ecosystem"))
    df = df.withColumn("ecosystem", eco).withColumn("ecosystems", F.array_sort(F.array_distinct(F.array_append("ecosystems", eco)))).drop("__eco")
    ranked = dimensions.ecosystems(spark).select("ecosystem", F.posexplode("lockfiles").alias("__rank", "__lock"))
    have = files.select(F.col("path").alias("__file"), parent(F.col("path")).alias("lockfile_owner"), basename(F.col("path")).alias("__lock"))
    lock = have.join(F.broadcast(ranked), "__lock").groupBy("lockfile_owner", "ecosystem").agg(F.min_by("__file", "__rank").alias("lockfile"))
    return df.join(lock, ["lockfile_owner", "ecosystem"], "left")


def assign_files(files: DataFrame, pkgs: DataFrame) -> DataFrame:
    """(path, package): of each kind the nearest package over the file."""
    parts = []
    for kind in ("cargo", "node"):
        own = pkgs.filter(F.col("kind") == kind).select("root", F.col("id").alias("package"))
        parts.append(nearest_owner(files.select("path"), "path", own, "root").select("path", "package"))
    return parts[0].unionByName(parts[1]).filter("package IS NOT NULL")


def _locks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import tomllib

    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            try:
                listed = tomllib.loads(text if text is not None else "\0").get("package") or []
                rows += [[path, p["name"], p["version"], p.get("source"), p.get("checksum"), None] for p in listed] or [[path, None, None, None, None, None]]
            except Exception as e:  # a broken lockfile is a row
                rows.append([path, None, None, None, None, str(e)[:200]])
        yield pd.DataFrame(rows, columns=["lockfile", "name", "version", "source", "checksum", "error"])


def resolutions(pkgs: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ecosystem, lockfile, name, version, source, checksum) of every package that the lockfiles of cargo packages list; diagnostics."""
    wanted = pkgs.filter("kind = 'cargo' AND lockfile IS NOT NULL").select(F.col("lockfile").alias("path")).distinct()
    rows = contents.join(F.broadcast(wanted), "path", "left_semi").select("path", "text").mapInPandas(_locks, "lockfile string, name string, version string, source string, checksum string, error string")
    found = rows.filter("name IS NOT NULL").select(F.lit("cargo").alias("ecosystem"), "lockfile", "name", "version", "source", "checksum")
    return found, rows.filter("error IS NOT NULL").select(F.lit("metadata").alias("kind"), F.col("lockfile").alias("path"), F.col("error").alias("message"))


def detected_projects(files: DataFrame, pkgs: DataFrame) -> DataFrame:
    """(package, language, e): languages that a configuration file in a package's root, or a declared dependency, tells."""
    spark = pkgs.sparkSession
    configs = F.broadcast(spark.createDataFrame([(lang, f, i) for lang, fs in dimensions.LANGUAGE_CONFIGS.items() for i, f in enumerate(fs)], "language string, name string, rank int"))
    named = F.broadcast(spark.createDataFrame([(lang, n) for lang, ns in dimensions.LANGUAGE_DEPENDENCIES.items() for n in ns], "language string, name string"))
    here = files.select(parent(F.col("path")).alias("root"), basename(F.col("path")).alias("name"), F.col("path").alias("e")).join(configs, "name")
    by_file = pkgs.select(F.col("id").alias("package"), "root").join(here, "root").groupBy("package", "language").agg(F.min_by("e", "rank").alias("e"))
    uses = pkgs.select(F.col("id").alias("package"), F.col("path").alias("manifest"), F.explode("dependencies").alias("d")).select("package", "manifest", F.col("d.name").alias("name"))
    by_name = uses.join(named, "name").select("package", "language", F.col("manifest").alias("e")).distinct()
    return by_file.unionByName(by_name.join(by_file.select("package", "language"), ["package", "language"], "left_anti"))


SOURCE_ROLES = ("programming", "markup", "stylesheet")


def package_languages(files: DataFrame, owners: DataFrame, pkgs: DataFrame) -> DataFrame:
    """(package, language, evidence): from the files it owns, from what its ecosystem implies, from configuration and dependencies."""
    spark = pkgs.sparkSession
    known = files.filter(F.col("role").isin(*SOURCE_ROLES)).select("path", "language")
    owned = owners.join(known, "path").select("package", "language", F.col("path").alias("e"))
    implied = F.broadcast(dimensions.ecosystems(spark).select("ecosystem", F.col("implies").alias("language")))
    said = pkgs.select(F.col("id").alias("package"), F.col("path").alias("e"), F.explode("ecosystems").alias("ecosystem")).join(implied, "ecosystem").select("package", "language", "e")
    every = owned.unionByName(said).unionByName(detected_projects(files, pkgs))
    return every.groupBy("package", "language").agg(F.array_sort(F.collect_set("e")).alias("evidence"))


def projects(files: DataFrame, pkgs: DataFrame, workspaces: DataFrame, languages: DataFrame) -> DataFrame:
    """(root, packages, languages, ecosystems, facets, evidence).

    Roots are those of packages and workspaces and the folders of language configuration, and the top where a source file has
    no other. Each source file belongs to the nearest root; a package's languages count where its own root is nearest.
    """
    text = "array<string>"
    names = [n for ns in dimensions.LANGUAGE_CONFIGS.values() for n in ns]
    beside = files.filter(basename(F.col("path")).isin(*names)).select(parent(F.col("path")).alias("root"))
    roots = pkgs.select("root").unionByName(workspaces.select("root")).unionByName(beside).distinct()
    source = files.filter(F.col("role").isin(*SOURCE_ROLES)).select("path", "language")
    near = lambda df: nearest_owner(df, "path", roots.withColumn("id", F.col("root")), "root").withColumn("root", F.coalesce("owner_root", F.lit("")))
    by_file = near(source).select("root", "language", F.col("path").alias("e"))
    said = languages.join(pkgs.select(F.col("id").alias("package"), F.col("root").alias("own")), "package").select("own", "language", F.explode("evidence").alias("path"))
    by_package = near(said).filter("root = own").select("root", "language", F.col("path").alias("e"))
    spoken = by_file.unionByName(by_package).distinct()
    every = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    tongues = spoken.groupBy("root").agg(every("language", "languages"))
    made = pkgs.groupBy("root").agg(every("id", "packages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ecosystems")))).alias("ecosystems"))
    proof = by_file.select("root", "e").unionByName(pkgs.select("root", F.col("path").alias("e"))).unionByName(workspaces.select("root", F.col("path").alias("e"))).groupBy("root").agg(every("e", "evidence"))
    here = files.select(parent(F.col("path")).alias("root"), basename(F.col("path")).alias("name"))
    web = pkgs.filter(F.exists("dependencies", lambda d: d["name"].isin(*dimensions.WEB_PACKAGES))).select("root").unionByName(here.filter(F.col("name").isin(*dimensions.WEB_CONFIGS)).select("root").join(pkgs.select("root"), "root", "left_semi"))
    tauri = here.filter(F.col("name").isin(*dimensions.TAURI_CONFIGS) & (basename(F.col("root")) == "src-tauri")).select(parent(F.col("root")).alias("root")).join(pkgs.select("root"), "root", "left_semi")
    facts = [(workspaces.filter("kind = 'cargo'").select("root"), "cargo-workspace"), (web, "static-site"), (tauri, "tauri")]
    facets = facts[0][0].withColumn("facet", F.lit(facts[0][1]))
    for df, name in facts[1:]:
        facets = facets.unionByName(df.withColumn("facet", F.lit(name)))
    facets = facets.groupBy("root").agg(every("facet", "facets"))
    out = roots.unionByName(spoken.select("root")).distinct()
    for part in (made, tongues, facets, proof):
        out = out.join(part, "root", "left")
    none = lambda c: F.coalesce(c, F.array().cast(text)).alias(c)
    return out.select("root", *[none(c) for c in ("packages", "languages", "ecosystems", "facets", "evidence")])


def artifacts(files: DataFrame, pkgs: DataFrame, found: DataFrame) -> DataFrame:
    """(profile, root, evidence): what projects (`found`) and packages make, by facets, dependencies, scripts, sources and declared binaries."""
    one = F.array("e").alias("evidence")
    by_facet = [found.filter(F.array_contains("facets", facet)).select(F.lit(profile).alias("profile"), "root", "evidence") for facet, profile in dimensions.FACET_ARTIFACTS]
    uses = lambda *names: F.exists("dependencies", lambda d: F.coalesce(d["package"], d["name"]).isin(*names)) if names else F.lit(False)
    says = lambda *words: F.exists("scripts", lambda s: F.array_max(F.array(*[s["command"].contains(w) for w in words])))
    by_package = [pkgs.filter(uses(*deps) | says(*signals)).select(F.lit(profile).alias("profile"), "root", F.array("path").alias("evidence")) for profile, deps, signals in dimensions.PACKAGE_ARTIFACTS]
    backends = found.filter(F.array_contains("facets", "tauri")).select(F.when(F.col("root") == "", "src-tauri").otherwise(F.concat("root", F.lit("/src-tauri"))).alias("root"))
    cargo = pkgs.filter("kind = 'cargo'").select("root", "path", "bins")
    # A source can make a binary of the one package whose src folder it stands in.
    marker = files.select("path", F.regexp_extract("path", r"^(?:(.*)/)?src/(?:main|bin/.*)\.rs$", 1).alias("root")).filter(F.col("path").rlike(r"^(.*/)?src/(main|bin/.*)\.rs$"))
    marker = marker.groupBy("root").agg(F.min("path").alias("marker"))
    source = cargo.join(marker, "root").join(backends, "root", "left_anti").select(F.lit("binary").alias("profile"), "root", F.array("path", "marker").alias("evidence"))
    declared = cargo.filter(F.size("bins") > 0).select(F.lit("binary").alias("profile"), "root", F.array("path").alias("evidence"))
    every = source.unionByName(declared)
    for x in (*by_facet, *by_package):
        every = every.unionByName(x)
    return every.groupBy("profile", "root").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


STAGES: list[tuple[int, str, Callable[[Tables], Tables]]] = []


def stage(phase: int, name: str) -> Callable[[Callable[[Tables], Tables]], Callable[[Tables], Tables]]:
    """Adds a stage: a function of named tables, run in the order of (phase, name)."""

    def add(f: Callable[[Tables], Tables]) -> Callable[[Tables], Tables]:
        if any(n == name for _, n, _ in STAGES):
            raise ValueError(f"a stage named {name} is registered")
        STAGES.append((phase, name, f))
        return f

    return add


@stage(0, "manifests")
def _manifests(t: Tables) -> Tables:
    parsed = cut(manifests(t["contents"]), "manifests")
    bad = parsed.filter("error IS NOT NULL").select(F.lit("manifest").alias("kind"), "path", F.col("error").alias("message"))
    return t | {"manifests": parsed, "packages": packages(parsed), "diagnostics": bad}


@stage(1, "relationships")
def _relationships(t: Tables) -> Tables:
    # Small tables that feed all that follows are written, so that plans stay short.
    pkgs, odd = resolve_ecosystems(t["packages"], t["files"])
    pkgs = cut(pkgs, "packages")
    pnpm = cut(pnpm_workspaces(t["contents"], t["manifests"]), "pnpm")
    specs = cut(workspace_specs(t["manifests"], pnpm), "workspaces")
    members, odd2 = resolve_workspaces(pkgs, specs)
    members = cut(members, "members")
    pkgs = cut(inherit(pkgs, members, t["files"]), "packages")
    owners = cut(assign_files(t["files"], pkgs), "owners")
    languages = cut(package_languages(t["files"], owners, pkgs), "languages")
    locked, odd3 = resolutions(pkgs, t["contents"])
    odd4 = pnpm.filter("error IS NOT NULL").select(F.lit("workspace").alias("kind"), "path", F.col("error").alias("message"))
    notes = t["diagnostics"].unionByName(odd).unionByName(odd2).unionByName(odd3).unionByName(odd4)
    return t | {"packages": pkgs, "members": members, "workspaces": specs.withColumnRenamed("ws", "root"), "owners": owners, "package_languages": languages, "resolutions": locked, "diagnostics": notes}


@stage(2, "projects")
def _projects(t: Tables) -> Tables:
    return t | {"projects": cut(projects(t["files"], t["packages"], t["workspaces"], t["package_languages"]), "projects")}


@stage(3, "artifacts")
def _artifacts(t: Tables) -> Tables:
    return t | {"artifacts": artifacts(t["files"], t["packages"], t["projects"])}


def inspect(tree: DataFrame) -> Tables:
    """All tables of a tree (path, size, head, text), by the registered stages."""
    out: Tables = {"files": cut(detect_language(tree.select("path", "size", "head"), first_line="head"), "files"), "contents": tree.select("path", "text")}
    for _, _, f in sorted(STAGES, key=lambda s: (s[0], s[1])):
        out = f(out)
    return out

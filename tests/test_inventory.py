"""Trees on disk to inventory and forge tables; streaming equals batch."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import forge, inventory
from factloom.sources import air, tree
from factloom.streaming import air as stream

TREE = {
    ".gitignore": "ignored/\n*.log\n!keep.log\n",
    "ignored/x.rs": "", "a.log": "", "keep.log": "", "target/debug/x.rs": "", "notes/build/n.md": "# n", "gone/x.rs": "",
    "Cargo.toml": '[workspace]\nmembers = ["crates/*", "nothing/*"]\nexclude = ["crates/old"]\n[package]\nname = "top"\n[dependencies]\nserde = "=1.0"\nown = { path = "crates/own", package = "own-real" }\n',
    "Cargo.lock": "", "src/main.rs": "fn main() {}", "crates/own/Cargo.toml": '[package]\nname = "own"\n', "crates/own/src/lib.rs": "", "crates/old/Cargo.toml": '[package]\nname = "old"\n',
    "web/package.json": '{"name": "web", "packageManager": "pnpm@9", "workspaces": ["packages/*"], "scripts": {"build": "vite build", "ci": "npm run lint && npm run test:unit", "lint": "eslint .", "test:unit": "vitest run"}, "dependencies": {"vite": "5.0.0"}}',
    "web/pnpm-lock.yaml": "", "web/build/out.js": "", "web/src/a.ts": "", "web/packages/p/package.json": '{"name": "p"}', "web/packages/p/i.js": "",
    "bad/package.json": "{", "tool": "#!/usr/bin/env python3\n", ".github/workflows/ci.yml": "on:\n  push:\n  pull_request:\njobs:\n  test:\n    name: Tests\n    defaults: {run: {working-directory: web}}\n    steps:\n      - uses: actions/checkout@v4\n      - run: |\n          npm run ci\n          cargo test && cargo fmt --check\n          echo 'open\n",
    ".github/workflows/broken.yml": "a: [", ".github/dependabot.yml": "version: 2\nupdates:\n  - package-ecosystem: npm\n    directory: /\n    schedule: {interval: weekly}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        p = top / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def tables(spark, root):
    tree.register(spark)
    df = spark.read.format("code_tree").option("content", "true").option("additional_ignores", "gone/**").load(root).persist()
    return {"tree": df} | inventory.inspect(df)


def test_walk(root):
    found = tree.walk(root, additional_ignores=("gone/**",))
    assert set(TREE) - set(found) == {"ignored/x.rs", "a.log", "target/debug/x.rs", "web/build/out.js", "gone/x.rs"}
    assert not any(p.startswith(".") for p in tree.walk(root, include_hidden=False)) and "target/debug/x.rs" in tree.walk(root, include_generated=True)
    assert found.index("src/main.rs") < found.index("tool") and tree.safe("a/b") and not tree.safe("../x") and not tree.safe("/x")
    with pytest.raises(ValueError):
        tree.walk(root + "/none")


def test_inventory(tables):
    files = {r["path"]: r["language"] for r in tables["files"].collect()}
    assert files["tool"] == "python" and files["web/src/a.ts"] == "typescript" and files["keep.log"] is None
    pkgs = {r["id"]: r for r in tables["packages"].collect()}
    assert set(pkgs) == {"cargo:.", "cargo:crates/own", "cargo:crates/old", "node:web", "node:web/packages/p"}
    assert pkgs["cargo:crates/own"]["workspace_root"] == "" and pkgs["cargo:crates/old"]["workspace_root"] is None and pkgs["cargo:."]["workspace_root"] == ""
    assert pkgs["node:web/packages/p"]["ecosystem"] == "pnpm" and pkgs["node:web/packages/p"]["lockfile"] == "web/pnpm-lock.yaml" and pkgs["cargo:crates/own"]["lockfile"] == "Cargo.lock"
    deps = {d["name"]: d for d in pkgs["cargo:."]["dependencies"]}
    assert deps["own"]["source"] == "local-path" and deps["own"]["package"] == "own-real" and deps["serde"]["requirement"] == "=1.0"
    owners = {(r["path"], r["package"]) for r in tables["owners"].collect()}
    assert ("web/packages/p/i.js", "node:web/packages/p") in owners and ("crates/own/src/lib.rs", "cargo:crates/own") in owners and ("web/src/a.ts", "cargo:.") in owners
    langs = {(r["package"], r["language"]) for r in tables["package_languages"].collect()}
    assert {("node:web", "typescript"), ("node:web", "javascript"), ("cargo:.", "rust")} <= langs
    made = {(r["profile"], r["root"]) for r in tables["artifacts"].collect()}
    assert made == {("binary", ""), ("site", "web")}
    notes = {(r["kind"], r["path"]) for r in tables["diagnostics"].collect()}
    assert notes == {("manifest", "bad/package.json"), ("workspace", "")}
    assert {r["root"]: r["languages"] for r in tables["projects"].collect()}["crates/own"] == ["rust"]


def test_forge(spark, tables):
    steps = forge.steps(tables["contents"]).cache()
    assert steps.filter("error IS NOT NULL").count() == 1 and [r["job"] for r in forge.pull_request_jobs(steps).collect()] == ["Tests"]
    cmds = forge.commands(steps.filter("run IS NOT NULL").select("path", "job", "step", "workdir", "run")).drop("run")
    assert [(r["segment"], r["program"]) for r in cmds.orderBy("segment").collect()] == [(0, "npm"), (1, "cargo"), (2, "cargo")]
    scripts = tables["packages"].select("root", F.explode("scripts").alias("s")).select("root", "s.name", "s.command")
    every = forge.expand_scripts(cmds, scripts).cache()
    assert {(r["program"], r["depth"]) for r in every.collect()} == {("npm", 0), ("cargo", 0), ("npm", 1), ("eslint", 2), ("vitest", 2)}
    tasks = {(r["tool"], r["task"]) for r in forge.classify_tools(every).collect()}
    assert tasks == {("cargo", "test"), ("cargo", "format"), ("javascript-linter", "lint"), ("javascript-test-runner", "test")}
    assert {(r["name"], r["task"]) for r in forge.script_tasks(scripts).collect()} == {("build", "build"), ("lint", "lint"), ("test:unit", "test")}
    updates = forge.dependency_updates(tables["contents"]).collect()
    assert len(updates) == 1 and updates[0]["ecosystem"] == "npm" and updates[0]["directories"] == ["/"]
    loop = spark.createDataFrame([("", "a", "npm run b"), ("", "b", "npm run a && tsc")], "root string, name string, command string")
    one = spark.createDataFrame([("k", "", 0, "npm", ["run", "a"])], "path string, workdir string, segment int, program string, arguments array<string>")
    assert {(r["program"], r["depth"]) for r in forge.expand_scripts(one, loop).collect()} == {("npm", 0), ("npm", 1), ("npm", 2), ("tsc", 2)}


def test_stream(spark, tmp_path):
    from test_engine import DUMP

    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.txt").write_text(DUMP)
    stream.store_stream(stream.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    batch = air.instructions(air.classify(air.read_dump(spark, str(tmp_path / "in"))))
    rows = lambda df: sorted((r["fn"], r["line_no"], r["op"], r["line"]) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out/instructions"))) == rows(batch) and batch.count() == 14


def test_outer_ignores(spark, tmp_path):
    top = tmp_path / "over" / "root"
    for path, text in {"over/.gitignore": "*.tmp\nroot/only/\n", "over/root/.git/info/exclude": "private\n", "over/root/a.tmp": "", "over/root/only/x": "", "over/root/private": "", "over/root/keep.tmp": "", "over/root/.gitignore": "!keep.tmp\n", "over/root/b.txt": "b", "rules": "b.*\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    names = [".gitignore", "a.tmp", "b.txt", "keep.tmp", "only/x", "private"]
    assert tree.walk(str(top)) == [n for n in names if n != "private"]
    assert tree.walk(str(top), respect_gitignore=False) == names
    assert tree.walk(str(top), parent_ignores=True) == [".gitignore", "b.txt", "keep.tmp"]
    assert tree.walk(str(top), global_gitignore=str(tmp_path / "rules")) == [".gitignore", "a.tmp", "keep.tmp", "only/x"]
    tree.register(spark)
    found = spark.read.format("code_tree").option("parent_ignores", "true").option("global_gitignore", str(tmp_path / "rules")).load(str(top))
    assert sorted(r["path"] for r in found.select("path").collect()) == [".gitignore", "keep.tmp"]
    read = tree.read_text(spark.createDataFrame([("b.txt",), ("../x",), ("/etc/passwd",), ("none",)], "path string"), str(top)).collect()
    assert {r["path"]: (r["text"], r["error"] is None) for r in read} == {"b.txt": ("b", True), "../x": (None, False), "/etc/passwd": (None, False), "none": (None, False)}


def test_split_dump(spark, tmp_path):
    """A file read in many splits has the lines, and the functions their ids, that it has read whole."""
    text = "".join(f"# Begin Function AIR: f{i}:\n# AIR Instructions: 1 (x)\n  %0 = add(u8, %{i})\n# End Function AIR: f{i}\n" for i in range(3000))
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = air.read_dump(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        got = [(r["file"][-5:], r["line_no"], r["value"]) for r in lines.collect()]
        assert sorted(got) == sorted((f"{n}.txt", i, x) for n in ("a", "b") for i, x in enumerate(text.splitlines()))
        ids = {(r["file"][-5:], r["mangled"]): r["id"] for r in air.numbered(air.classify(lines))[0].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert ids == {(f"{n}.txt", f"f{i}"): i + 3000 * k for k, n in enumerate(("a", "b")) for i in range(3000)}


def test_leading_type(spark):
    texts = ["u8, %1", "struct { a: u8, b: u16 }, x", "fn (a, [2]b) c", "a(b(c(d(e(f,g),h),i),j),k), z", "->x, y", "", "%1, u8", "@as(u8, 1), u8", "a], b", "((", "a<b,c>, d"]
    slow = []
    for t in texts:
        depth, out = 0, ""
        for c in t:
            if c == "," and depth == 0:
                break
            depth += (c in "([{<") - (c in ")]}>")
            out += c
        slow.append("" if out.strip()[:1] in ("%", "@") else out.strip())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(air.leading_type(F.col("t"))).collect()] == slow

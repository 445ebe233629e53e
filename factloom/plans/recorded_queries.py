"""Queries over recorded facts given as rows: rewrites, parser packs, corpora, parse results, observations."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions
from ..operators import corpora, idioms, packs, recorded, rewrite, semantics, stats
from ..shared import shared_dir
from ..sources import air

SOURCES = [
    ("a.rs", "rust", "pub const trait A {}\nimpl const Default for X {}\nfn f() { let x = &raw const y; become g(); try { 1 } }\nconst X: u8 = 1;"),
    ("b.py", "python", "lazy import os\nx = lazy\n    lazy from a import b\nlazy_import = 1"),
    ("c.c", "c", "static int f(int a UNUSED)\n{\n\tfor_each_string_list_item(item, list) {}\n}\nstatic GIT_PATH_FUNC(p,\n \"x\");\nx = container_of(p, struct foo, member);\nva_arg(ap, char *);\n#define UNUSED x UNUSED\n"),
    ("d.zig", "zig", "fn f(x: if (a) u8 else u16) void {}\nconst y = if (a) 1 else 2;\nreturn !if (x) y else z;"),
    ("e.c", "c", "int UNUSED_x(void);\nint é UNUSED;\n"),
    ("f.go", "go", "const trait"),
]


def rewrites_applied(spark: SparkSession, _: str) -> DataFrame:
    rows = rewrite.rewrites(spark.createDataFrame(SOURCES, "path string, language string, text string"))
    same = F.octet_length("rewritten") == F.octet_length("text")
    return rows.select("path", "rewritten", F.array_join("rewrites", ",").alias("rewrites"), "narrowed", same.alias("same_length"))


def rewrite_rules(spark: SparkSession, _: str) -> DataFrame:
    return rewrite.rule_table(spark).groupBy("language", "rule").agg(F.count("*").alias("n"))


def _manifest(name: str, language: str, grammar: bytes, more: str = "", files: str = "", version: str = "1") -> str:
    return (
        f'schema = {version}\nid = "{name}"\nlanguage = "{language}"\nversion = "1.0"\nsource = "s"\nrevision = "r"\nlicense = "MIT"\nabi = 15\nsha256 = "{hashlib.sha256(grammar).hexdigest()}"\ncomparison-domain = "{language}"\n{more}'
        f"[files]\n{files}\n"
    )


PACKS = {
    "packs/rust/parser.toml": _manifest("rust", "rust", b"g1", files='extensions = ["rs"]') + '[error-handling]\nfallible-types = ["Result"]\n[tests]\nmarkers = ["test"]\n',
    "packs/rust/grammar.wasm": "g1",
    "packs/rust/queries/b.scm": "(b)",
    "packs/rust/queries/a.scm": "(a)",
    "packs/rust2/parser.toml": _manifest("rust-general", "rust", b"g2"),
    "packs/rust2/grammar.wasm": "g2",
    "packs/rust2/queries/a.scm": "(a)",
    "packs/rust3/parser.toml": _manifest("rust-again", "rust", b"g3", files='filenames = ["build.rs"]'),
    "packs/rust3/grammar.wasm": "g3",
    "packs/wrong/parser.toml": _manifest("wrong", "zig", b"other", files='extensions = ["zig"]'),
    "packs/wrong/grammar.wasm": "g4",
    "packs/odd/parser.toml": _manifest("odd", "python", b"g5", files='extensions = [".py"]'),
    "packs/odd/grammar.wasm": "g5",
    "packs/new/parser.toml": _manifest("new", "python", b"g6", version="2"),
    "packs/strange/parser.toml": _manifest("strange", "klingon", b"g7"),
    "packs/strange/grammar.wasm": "g7",
    "single/parser.toml": _manifest("python", "python", b"g8"),
    "single/grammar.wasm": "g8",
}


def _packs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(p, t.encode()) for p, t in PACKS.items()]
    return packs.discover(spark.createDataFrame(rows, "path string, content binary"), ["packs", "single"])


def parser_packs(spark: SparkSession, _: str) -> DataFrame:
    return _packs(spark)[0].select("id", "language", "root", F.array_join("extensions", ",").alias("extensions"), F.array_join("names", ",").alias("queries"), "queries_sha256")


def parser_pack_errors(spark: SparkSession, _: str) -> DataFrame:
    return _packs(spark)[1]


def parser_resolution(spark: SparkSession, _: str) -> DataFrame:
    files = spark.createDataFrame([("x/a.rs", "rust"), ("x/b.rs.in", "rust"), ("c.py", "python"), ("d.zig", "zig"), ("build.rs", "rust")], "path string, language string")
    return packs.resolve(files, _packs(spark)[0])


def parser_differences(spark: SparkSession, _: str) -> DataFrame:
    return packs.differences(_packs(spark)[0])


def parser_vocabulary(spark: SparkSession, _: str) -> DataFrame:
    return packs.vocabulary(_packs(spark)[0])


CORPUS = {
    "Task/Sum/C/a.c": "int a;\n", "Task/Sum/C/b.c": "int a;\nint b;\nint c; // x\n", "Task/Sum/C/c.h": "int a;\n", "Task/Sum/Python/a.py": "a = 1\n# b\n", "Task/Max/Python/a.py": "# only a comment\n", "Task/Max/UNIX-Shell/a.sh": "echo\n",
    "impls/rust/src/main.rs": "fn main() {}\n", "impls/rust/tests/x.rs": "fn t() {}\n", "impls/rust/src/build.rs": "fn b() {}\n", "impls/python3/core.py": "a = 1\nb = 2\n", "impls/python3/test_core.py": "c = 3\n", "impls/python3/notes.md": "x\n",
    "rust/exercises/practice/one/.meta/config.json": json.dumps({"files": {"example": [".meta/example.rs", "Cargo.toml"]}}), "rust/exercises/practice/one/.meta/example.rs": "fn a() {}\nfn b() {}\n", "rust/exercises/practice/one/Cargo.toml": "[package]\n",
    "python/exercises/practice/one/.meta/config.json": json.dumps({"files": {"exemplar": [".meta/exemplar.py"]}}), "python/exercises/practice/one/.meta/exemplar.py": "a = 1\n", "python/exercises/practice/two/.meta/config.json": "{", "python/exercises/practice/two/x.py": "a\n",
}


def _corpus(spark: SparkSession, prefix: str = "") -> DataFrame:
    return spark.createDataFrame([(p, t) for p, t in CORPUS.items() if p.startswith(prefix)], "path string, text string")


def corpus_samples(spark: SparkSession, _: str) -> DataFrame:
    files = _corpus(spark)
    return reduce(DataFrame.unionByName, [read(files).withColumn("layout", F.lit(name)) for name, read in corpora.READERS.items()])


def corpus_layouts(spark: SparkSession, _: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [corpora.detect(_corpus(spark, p)).withColumn("prefix", F.lit(p)) for p in ("", "impls", "rust", "Task")])


def published_index(spark: SparkSession, _: str) -> DataFrame:
    """The index fitted to the published ratios is the published index."""
    found = stats.fit(corpora.published_ratios(spark).withColumn("tasks", F.lit(1)), "c")
    return found.select("language", F.round("lines", 4).alias("lines"), F.round("bytes", 4).alias("bytes"))


def compiler_observation(spark: SparkSession, _: str) -> DataFrame:
    rows = [
        ("rustc 1.93.1 (01f4d6f7f 2026-02-11)\nbinary: rustc\ncommit-hash: 01f4d6f7f\nhost: aarch64-apple-darwin\nrelease: 1.93.1\n", 'target_arch="aarch64"\ntarget_feature="neon"\ntarget_feature="aes"\n\n', "/toolchains/stable\n"),
        ("rustc 1.80.0\nhost: x86_64\n", "unix\nunix\n", "/t"), ("rustc 1.80.0\n", "", "/t"), ("", "", "/t"), ("rustc 1\nhost: x\n", "", " "),
    ]
    c = recorded.compiler(spark.createDataFrame(rows, "verbose string, cfg string, sysroot string"))
    return c.select("version", "commit", "host", "sysroot", F.array_join("cfg", ",").alias("cfg"), F.array_join("target_features", ",").alias("target_features"), "error")


NODES = [("a.rs", 0, 0, 90, 1, "fn x\nfn y"), ("a.rs", 1, 10, 20, 2, "  become g()  \nx"), ("a.rs", 2, 40, 50, 4, "other"), ("b.rs", 0, 5, 9, 1, "become g()"), ("c.rs", 0, 0, 5, 7, "x" * 80)]


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NODES, "path string, visit int, start int, end int, line int, excerpt string")


def first_errors(spark: SparkSession, _: str) -> DataFrame:
    return recorded.first_error(_nodes(spark))


def parse_rate(spark: SparkSession, _: str) -> DataFrame:
    files = spark.createDataFrame([("a.rs", 100, 3, True), ("b.rs", 50, 1, False), ("c.rs", 20, 0, False), ("d.rs", 30, 2, True)], "path string, bytes long, units long, rewritten boolean")
    return recorded.parse_rate(files, _nodes(spark))


def error_heads(spark: SparkSession, _: str) -> DataFrame:
    return recorded.error_heads(_nodes(spark))


def container_kinds(spark: SparkSession, _: str) -> DataFrame:
    rows = [("struct_declaration", "extern"), ("struct_declaration", None), ("union_declaration", "packed"), ("enum_declaration", "extern"), ("opaque_declaration", None), ("block", None)]
    t = spark.createDataFrame(rows, "node string, modifier string").withColumn("kind", recorded.container_kind(F.col("node"), F.col("modifier")))
    return t.withColumn("external", recorded.is_extern(F.col("kind")))


def receivers(spark: SparkSession, _: str) -> DataFrame:
    rows = [("deinit", "a.Foo", "*Foo"), ("deinit", "a.Foo", "?*const Foo"), ("destroy", "a.Foo", "Bar"), ("init", "a.Foo", "@This()"), ("finalize", "", "Foo"), ("deinit", "Foo", None)]
    t = spark.createDataFrame(rows, "name string, container string, written string")
    return t.withColumns({"receiver": recorded.is_receiver(F.col("container"), F.col("written")), "frees": recorded.is_deinit(F.col("name"), F.col("container"), F.col("written"))})


def locals_and_calls(spark: SparkSession, _: str) -> DataFrame:
    rows = [("", "Ctx{ .a = 1 }", "self.list.?items"), ("?*const a.B", "x", "&map"), ("", "f(x) { }", "a"), ("", "none", "*p.&q")]
    t = spark.createDataFrame(rows, "written string, value string, receiver string")
    return t.withColumns({"container": recorded.local_container(F.col("written"), F.col("value")), "tail": recorded.receiver_tail(F.col("receiver"))})


def argument_binding(spark: SparkSession, _: str) -> DataFrame:
    calls = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y"), ("f", 2, "z"), ("g", 0, "w")], "callee string, index int, text string")
    params = spark.createDataFrame([("f", 0, "self", "*Foo"), ("f", 1, "n", "u8")], "callee string, index int, name string, written string")
    return recorded.bound_arguments(calls, params)


def entity_ids(spark: SparkSession, _: str) -> DataFrame:
    rows = [("/x/lib.es5.d.ts", "Array.filter", "x", 0, 0), ("/a/node_modules/@t/p/i.d.ts", "P.q", "x", 0, 0), ("/a/node_modules/b/node_modules/c/i.ts", "c", "x", 1, 2), ("/a/src/m.ts", "m", "src/m.ts", 4, 6)]
    t = spark.createDataFrame(rows, "file string, qualified string, relative string, line int, col int")
    return t.select("file", semantics.entity_id(*[F.col(c) for c in ("file", "qualified", "relative", "line", "col")]).alias("id"))


def dispatch_order(spark: SparkSession, _: str) -> DataFrame:
    t = spark.createDataFrame([(d,) for d in ("unknown", "static", "virtual", "unmonomorphized", "odd")], "dispatch string")
    return t.withColumn("rank", semantics.dispatch_rank(F.col("dispatch")))


def _unit(name: str, toolchain: str, calls: bool, line: int) -> dict:
    span = {"path": "src/a.rs", "start_line": line, "start_column": 1, "end_line": line, "end_column": 9}
    asked = {"definitions": True, "references": False, "call_edges": calls, "types": True, "implements": True}
    return {
        "schema": 1, "provenance": {"provider": "p", "provider_version": "1", "toolchain": toolchain, "unit": name}, "coverage": asked, "definitions": [{"id": "d1", "kind": "fn", "name": "d", "container": None, "visibility": "pub", "span": span}],
        "references": [], "call_edges": [{"span": span, "from": "d1", "to": ["x", "y"], "dispatch": "virtual"}], "types": [], "implements": [], "gaps": [],
    }


def _documents(spark: SparkSession) -> DataFrame:
    path = f"{shared_dir(spark)}/observations"
    texts = [json.dumps(_unit("u1", "t1", True, 3)), json.dumps(_unit("u2", "t2", False, 3)), json.dumps(_unit("u3", "t1", True, 8)), "{", json.dumps({"schema": 2})]
    # One file each, as providers write them.
    spark.createDataFrame(list(enumerate(texts)), "n int, value string").repartition(5, "n").sortWithinPartitions("n").select("value", "n").write.mode("overwrite").partitionBy("n").text(path)
    return semantics.read_documents(spark, f"{path}/n=*")


def observation_documents(spark: SparkSession, _: str) -> DataFrame:
    """(table, rows) of documents that were read, merged, written as one and read again."""
    docs = _documents(spark)
    merged = semantics.merge([semantics.tables(docs)], "all")
    path = f"{shared_dir(spark)}/observations-all"
    semantics.write_documents(semantics.document({**merged, "gaps": merged["gaps"].select("path", *semantics.SPAN[1:], "message")}, "all"), path)
    again = semantics.tables(semantics.read_documents(spark, path))
    rows = [again[t].agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in (*semantics.TABLES, "units")]
    bad = semantics.bad_documents(docs).agg(F.count("*").alias("rows")).select(F.lit("bad").alias("name"), "rows")
    return reduce(DataFrame.unionByName, [*rows, bad])


def merge_provenance(spark: SparkSession, _: str) -> DataFrame:
    merged = semantics.merge([semantics.tables(_documents(spark))], "all")
    asked = merged["coverage"].select("definitions", "references", "call_edges")
    return merged["provenance"].select("unit", "toolchain", "provider").join(F.broadcast(asked))


def generated_directories(spark: SparkSession, _: str) -> DataFrame:
    """Directories that hold what was made, by their names and the marker files over them."""
    paths = ["web/package.json", "web/build/a.js", "web/src/build/b.js", "notes/build/n.md", "Cargo.toml", "x/target/debug/t", "x/__pycache__/m.pyc", "lib/dist/d.js"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    folders = files.select(F.explode(idioms.ancestors(F.col("path"), own=False)).alias("a")).select(F.col("a.root").alias("path")).filter("path <> ''").distinct()
    markers = spark.createDataFrame([(n, m) for n, ms in dimensions.TRAVERSAL.items() for m in (ms or (None,))], "name string, marker string")
    return idioms.with_marker(folders, files, markers)


def dump_balance(spark: SparkSession, d: str) -> DataFrame:
    from .registry import dump

    return air.balances(air.classify(dump(spark, d)))


def dump_function_ids(spark: SparkSession, d: str) -> DataFrame:
    """Functions of a dump in one sequence over its files."""
    from .registry import dump

    return air.numbered(air.classify(dump(spark, d)))[0].select("mangled", "id")


def shared_tasks(spark: SparkSession, d: str) -> DataFrame:
    from .registry import SHARED, samples

    s = samples(spark, d)
    return corpora.counts(stats.pairs(s, SHARED), s, ["de", "en", "es", "fr"])


QUERIES = {
    f.__name__: f
    for f in (
        rewrites_applied, rewrite_rules, parser_packs, parser_pack_errors, parser_resolution, parser_differences, parser_vocabulary, corpus_samples, corpus_layouts, published_index, compiler_observation, first_errors, parse_rate, error_heads,
        container_kinds, receivers, locals_and_calls, argument_binding, entity_ids, dispatch_order, observation_documents, merge_provenance, generated_directories, dump_balance, dump_function_ids, shared_tasks,
    )
}

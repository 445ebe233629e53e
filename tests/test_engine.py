"""Laws and small cases of the engine's own operators."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import dimensions
from factloom.functions import text as T
from factloom.operators import classify, idioms, semantics, stats
from factloom.sources import air


def strip(text, syntax):
    """The scanner as a loop: multi-quotes, then blocks, then lines, then quotes."""
    out, i, n = [], 0, len(text)
    while i < n:
        m = next((q for q in sorted(syntax.multi_quotes, key=len, reverse=True) if text.startswith(q, i)), None)
        if m:
            j = i + len(m)
            while j < n and not text.startswith(m, j):
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + len(m))
            out.append(text[i:j])
        elif b := next(((a, z) for a, z in syntax.block if text.startswith(a, i)), None):
            j = text.find(b[1], i + len(b[0]))
            j = n if j < 0 else j + len(b[1])
            out.append("\n" * text.count("\n", i, j))
        elif any(text.startswith(x, i) for x in syntax.line):
            j = text.find("\n", i)
            j = n if j < 0 else j
        elif text[i] in syntax.quotes:
            j = i + 1
            while j < n and text[j] not in (text[i], "\n"):
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + 1)
            out.append(text[i:j])
        else:
            j = i + 1
            out.append(text[i])
        i = j
    return "".join(out)


@pytest.mark.parametrize("name", sorted(dimensions.SYNTAXES))
def test_strip_comments(spark, name):
    syntax = dimensions.SYNTAXES[name]
    rng = random.Random(name)
    alphabet = ["a", " ", "\n", "\\", "x1", *syntax.quotes, *syntax.multi_quotes, *syntax.line, *(x for b in syntax.block for x in b)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(400)] + ['"' + "a\\n" * 20000 + '"', ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", T.strip_comments(F.col("t"), syntax).alias("s")).collect():
        assert r["s"] == strip(r["t"], syntax)


def test_measure(spark):
    m = spark.createDataFrame([("  a  \n# b\n\n é # c\n",)], "t string").select(T.measure(F.col("t"), dimensions.SYNTAXES["hash"]).alias("m"), T.measure(F.col("t"), None).alias("n")).first()
    assert (m["m"]["lines"], m["m"]["bytes"], m["n"]) == (2, 3, None)


def samples(spark, rows):
    return spark.createDataFrame(rows, "language string, task string, lines long, bytes long")


def test_statistics(spark):
    s = samples(spark, [("a", "one", 10, 10), ("a", "two", 40, 40), ("a", "three", 5, 5), ("b", "one", 5, 5), ("b", "two", 10, 10)])
    p = stats.pairs(s, 2).collect()
    assert len(p) == 1 and p[0]["tasks"] == 2 and abs(p[0]["bytes"] - math.sqrt(8)) < 1e-12
    exact = samples(spark, [(x, t, n * k, n * k) for x, k in (("a", 4), ("b", 2), ("c", 1)) for t, n in (("u", 10), ("v", 30))])
    p = stats.pairs(exact, 2)
    index = {r["language"]: r["bytes"] for r in stats.fit(p, "c").collect()}
    assert np.allclose([index["a"], index["b"], index["c"]], [4, 2, 1])
    assert all(r["deviation"] < 1e-9 for r in stats.deviation(p, stats.fit(p, "c")).collect())
    t = stats.triangles(p).collect()
    assert len(t) == 1 and abs(t[0]["composed"] - t[0]["direct"]) < 1e-9
    panel = samples(spark, [("a", "one", 1, 1), ("a", "two", 2, 2), ("b", "two", 4, 4), ("b", "three", 1, 1)])
    both = panel.select("language").distinct()
    assert [r[0] for r in stats.balanced_panel(panel, both).collect()] == ["two"]
    assert {r["language"]: r["bytes"] for r in stats.balanced_index(panel, both, "a").collect()} == pytest.approx({"a": 1.0, "b": 2.0})
    assert stats.floor_units(panel, 3).count() == 0 and stats.floor_units(panel, 2).count() == 4
    asked = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "left string, right string")
    assert {(r[0], r[1]): r[2] for r in stats.ratio_lookup(p, asked).collect()} == {("a", "b"): pytest.approx(2), ("b", "a"): pytest.approx(0.5), ("a", "a"): None}


def test_paths(spark):
    owners = spark.createDataFrame([("", 0), ("crates/core", 1), ("crates", 2)], "root string, id int")
    items = spark.createDataFrame([("crates/core2/a",), ("crates/core/a",), ("x",), ("crates/core",)], "path string")
    got = {r["path"]: r["id"] for r in idioms.nearest_owner(items, "path", owners, "root").collect()}
    assert got == {"crates/core2/a": 2, "crates/core/a": 1, "x": 0, "crates/core": 1}
    n = spark.createDataFrame([("a/b", "../c/./d"), ("", "../x"), ("a", "")], "b string, p string").select(idioms.normalize_relative(F.col("b"), F.col("p"))).collect()
    assert [r[0] for r in n] == ["a/c/d", "x", "a"]
    files = spark.createDataFrame([("a/Makefile", ""), ("b/X.PY", ""), (".gitignore", ""), ("run", "#!/usr/bin/env python3"), ("x.h", "#!/bin/sh"), ("y", "#!/bin/zsh -e")], "path string, head string")
    assert {r["path"]: (r["language"], r["evidence"]) for r in classify.detect_language(files, first_line="head").collect()} == {
        "a/Makefile": ("make", "filename"), "b/X.PY": ("python", "extension"), ".gitignore": (None, None), "run": ("python", "shebang"), "x.h": ("c", "extension"), "y": ("shell", "shebang"),
    }


DUMP = """# Begin Function AIR: a.init:
# Total AIR+Liveness bytes: 624B
# AIR Instructions:         32 (288B)
  %0 = arg(mem.Allocator, 0)
  %6!= dbg_stmt(2:35)
  %8 = field_ptr(**a.Inner, %7!)
  %17 = try(%10, {
    %11 = unwrap(error{OutOfMemory}, %10!)
  } %10!)
  %1! %2!
  %x = broken(
  %21!= store_safe(%8!, %20!)
# End Function AIR: a.init
stray
# Begin Function AIR: b:
  %0 = noargs"""


def test_dump(spark):
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(DUMP.split("\n"))], air.SCHEMA)
    c = air.classify(lines).cache()
    t = {r[0]: r[1] for r in air.tally(c).collect()}
    assert t == {"begin": 2, "end": 1, "header": 2, "instruction": 7, "delimiter": 1, "death": 1, "unparsed": 1, "other": 1} and sum(t.values()) == lines.count()
    f = {r["mangled"]: r for r in air.functions(c).collect()}
    assert (f["a.init"]["declared_instructions"], f["a.init"]["read_instructions"], f["a.init"]["air_bytes"]) == (32, 6, 624) and f["b"]["read_instructions"] == 1
    i = {(r["fn"], r["index"]): r for r in air.instructions(c).collect()}
    assert i[1, 0]["result_type"] == "mem.Allocator" and i[1, 6]["dead"] and (i[1, 6]["line"], i[1, 8]["line"], i[1, 8]["column"]) == (0, 2, 35)
    assert i[1, 11]["depth"] == 1 and i[1, 11]["result_type"] == "error{OutOfMemory}" and i[1, 21]["operands"] == [8, 20] and i[2, 0]["op"] == "noargs" and i[2, 0]["line"] == 0


def observations(spark, tool, rows, asked=True):
    span = "path string, start_line int, start_column int, end_line int, end_column int"
    edges = spark.createDataFrame([(p, n, 1, n, 9, a, b, "static") for p, n, a, b in rows], f"{span}, from string, to array<string>, dispatch string")
    units = spark.createDataFrame([(tool, 0 if tool == "t1" else 1, tool, *[asked] * 5)], "unit string, ordinal int, toolchain string, " + ", ".join(f"{q} boolean" for q in semantics.QUESTIONS))
    return {"call_edges": edges, "units": units, "gaps": spark.createDataFrame([], f"{span}, message string")}


def test_observations(spark):
    a = observations(spark, "t1", [("r/a", 1, "x", ["y"]), ("r/a", 1, "x", ["y"]), ("q/a", 2, "x", ["z", "y"])])
    b = observations(spark, "t2", [("r/a", 1, "x", ["y"]), ("r2/a", 1, "x", ["y"])], asked=False)
    one, two = semantics.merge([a, b]), semantics.merge([b, a])
    key = lambda o: sorted(map(str, o["call_edges"].collect()))
    assert key(one) == key(two) and len(key(one)) == 3 and semantics.merge([]) is None
    assert not any(semantics.coverage(one["units"]).first()) and all(semantics.coverage(a["units"]).first())
    assert [r["message"] for r in one["gaps"].collect()] == ["unit t2 was observed with t2 instead of t1"]
    assert [r["path"] for r in semantics.rebase(one, "r")["call_edges"].collect()] == ["a"] and key(semantics.rebase(one, ".")) == key(one)
    spans = one["call_edges"].select(*semantics.SPAN).filter("path = 'q/a'")
    assert sorted(r["callee"] for r in semantics.callees(one["call_edges"], spans).collect()) == ["y", "z"]
    heads = spark.createDataFrame([("Map<string, A>",), ("A[]",), ("{ a: 1 }",), ("x.Y",)], "d string").select(semantics.type_head(F.col("d"))).collect()
    assert [r[0] for r in heads] == ["Map", "Array", "(anonymous)", "x.Y"]
    pk = spark.createDataFrame([("a/node_modules/b/node_modules/@s/p/i.d.ts",), ("a/node_modules/left/i.ts",), ("src/a.ts",)], "p string").select(semantics.package_of(F.col("p"))).collect()
    assert [r[0] for r in pk] == ["@s/p", "left", None]


def test_registry():
    dimensions.check()
    assert len(dimensions.LANGUAGES) == 29 and len(dimensions.SYNTAXES) == 11 and len(dimensions.ECOSYSTEMS) == 5
    assert all(re.compile(T.pattern(s, possessive=False).replace("\\z", "\\Z")) for s in dimensions.SYNTAXES.values())


def test_contract(spark, sf):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and e.entry(spark).count() > 0
    for name in ("air_roundtrip_functions", "line_tally", "callees", "nearest_owner", "invocations"):
        assert queries[name](spark, sf).columns


def test_innermost(spark):
    rng = random.Random(8)
    outer = [(rng.choice("ab"), s, s + rng.randint(0, 60), i) for i in range(60) for s in [rng.randint(0, 200)]]
    inner = sorted({(rng.choice("abc"), s, s + rng.randint(0, 10)) for _ in range(80) for s in [rng.randint(0, 220)]})
    o, i = spark.createDataFrame(outer, "f string, start long, end long, id long"), spark.createDataFrame(inner, "f string, start long, end long")
    for strict in (False, True):
        got = {tuple(r)[:3]: r["around"] for r in idioms.innermost(i, o, ["f"], strict).collect()}
        for f, a, b in inner:
            around = [(e - s, n) for g, s, e, n in outer if g == f and s <= a and b <= e and (not strict or b - a < e - s)]
            assert got[f, a, b] == (min(around)[1] if around else None)
    assert idioms.innermost(i, o.limit(0), ["f"]).filter("around IS NULL").count() == len(inner)

"""Parsing with a grammar of our own: brackets must match, `fn` begins a unit, macros that rewrites blank are errors."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import parse, recorded
from factloom.plans import recorded_queries


def brackets():
    import re

    class Brackets:
        def __init__(self, pack):
            if pack["id"] == "rust-general":
                raise ValueError("the grammar is of another version")
            self.pack = pack

        def parse(self, text):
            nodes, depth = [], 0
            for m in re.finditer(rb"[{}]|become", text):
                depth += {b"{": 1, b"}": -1}.get(m[0], 0)
                if m[0] == b"become" or depth < 0:
                    nodes.append((m.start(), m.end(), text.count(b"\n", 0, m.start()) + 1))
                    depth = max(depth, 0)
            if depth:
                nodes.append((0, len(text), 1))
            return len(re.findall(rb"\bfn\b", text)), nodes

        def query(self, name, text):
            return [(0, {"name": m.span(1)} | ({"body": m.span(2)} if m[2] else {})) for m in re.finditer(rb"fn (\w+)\s*(\{[^}]*\})?", text)]

    Brackets.__module__ = "__main__"  # sent by value: workers do not have this module
    return Brackets


load = brackets()


def test_parse_repository(spark):
    packs = recorded_queries._packs(spark)[0]
    files = [
        ("a.rs", "rust", "fn x() {}\nfn y", "programming"), ("b.rs", "rust", "fn x() { become g(); }", "programming"), ("c.rs", "rust", "fn x() {\n}}", "programming"), ("d.rs.in", "rust", "fn q", "programming"),
        ("e.zig", "zig", "fn", "programming"), ("f.zig", "zig", "fn", "programming"), ("g.md", "markdown", "x", "data"), ("h.py", "python", "{", "programming"), ("i.rs", "rust", None, "programming"),
    ]
    df = spark.createDataFrame(files, "path string, language string, text string, role string")
    sound, notes = parse.parse_repository(df, packs, load)
    got = {r["path"]: r for r in sound.collect()}
    assert set(got) == {"a.rs", "b.rs"} and got["a.rs"]["units"] == 2 and not got["a.rs"]["rewritten"]
    assert got["b.rs"]["text"] == "fn x() {        g(); }" and got["b.rs"]["rewrites"] == ["Blank:become"] and not got["b.rs"]["narrowed"]
    told = {r["path"]: r["message"] for r in notes.collect()}
    assert told == {"c.rs": "line 2: the grammar can't read `}`", "h.py": "line 1: the grammar can't read `{`", "d.rs.in": "the grammar is of another version", "e.zig": "no pack reads zig: 2 files"}
    found = parse.matches(sound, packs.filter("id = 'rust'"), load, "a").filter("path = 'a.rs'").collect()
    assert sorted((r["match"], r["capture"], r["text"]) for r in found) == [(0, "name", "x"), (1, "name", "y")]
    with pytest.raises(ValueError):
        parse.matches(sound, packs, load, "b")
    parsed = parse.parse(df, packs, load)
    rate = recorded.parse_rate(parsed.filter("error IS NULL").select("path", "bytes", "units", "rewritten"), parse.nodes_of(parsed)).first()
    assert (rate["files"], rate["errored"], rate["rewritten"], rate["unreadable_bytes"]) == (4, 2, 1, 2)
    assert parse.parse(df.filter(F.col("language") == "none"), packs, load).count() == 0

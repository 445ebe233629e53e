"""Parsing of a repository by grammars that the caller brings.

A backend is what a grammar and its queries are loaded into, once a Python worker: `load(pack)` makes one of a pack's row, and fails if
the grammar or a query can't be used. It then answers `parse(text)` with (units, error nodes) and `query(name, text)` with matches.
No grammar is shipped; rewrites, provenance, errors and matches are handled here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packs as packs_
from . import recorded
from .rewrite import neutralize

#: (start, end, line) of an error node, in the order they are visited; places are bytes.
Node = tuple[int, int, int]
#: (pattern, {capture: (start, end)}) of a match; a capture that is bound to nothing is left out.
Match = tuple[int, dict[str, tuple[int, int]]]


class Backend(Protocol):
    def parse(self, text: bytes) -> tuple[int, list[Node]]: ...

    def query(self, name: str, text: bytes) -> list[Match]: ...


Load = Callable[[dict], Backend]
PARSED = "path string, pack string, text string, source_sha256 string, rewrites array<string>, narrowed boolean, rewritten boolean, bytes long, units long, nodes array<struct<visit:int,start:int,end:int,line:int,excerpt:string>>, error string"
_NAMES = [c.split()[0] for c in PARSED.replace("array<struct<visit:int,start:int,end:int,line:int,excerpt:string>>", "x").split(", ")]


class Backends:
    """The backends of a worker, each loaded when its pack is first met; one that can't be loaded stays an error."""

    def __init__(self, load: Load, rows: list[dict]) -> None:
        self.load, self.rows, self.made = load, {r["id"]: r for r in rows}, {}

    def __getitem__(self, pack: str) -> Backend:
        if pack not in self.made:
            try:
                self.made[pack] = self.load(self.rows[pack])
            except Exception as e:
                self.made[pack] = e
        if isinstance(self.made[pack], Exception):
            raise self.made[pack]
        return self.made[pack]


def parse_text(backend: Backend, language: str, text: str) -> dict:
    """What a grammar makes of a text: of the rewritten one, if only that is free of errors."""
    kept, rewrites, narrowed = text, [], False
    units, nodes = backend.parse(text.encode())
    if nodes and (other := neutralize(language, text)):
        again = backend.parse(other[0].encode())
        if not again[1]:
            (units, nodes), (kept, rewrites, narrowed) = again, other
    raw = kept.encode()
    excerpts = [(i, a, b, line, raw[a:b].decode("utf-8", "ignore")[:200]) for i, (a, b, line) in enumerate(nodes)]
    return {"text": kept, "source_sha256": hashlib.sha256(raw).hexdigest(), "rewrites": rewrites, "narrowed": narrowed, "rewritten": bool(rewrites), "bytes": len(raw), "units": units, "nodes": excerpts}


def parse(files: DataFrame, packs: DataFrame, load: Load) -> DataFrame:
    """A row per file of `files` (path, language, text) that some pack reads; packs are few and go out with the plan."""
    rows = [r.asDict(recursive=True) for r in packs.collect()]
    known = packs_.resolve(files.select("path", "language", "text"), packs).filter("pack IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backends = Backends(load, rows)
        for b in batches:
            out = []
            for path, language, text, pack in zip(b["path"], b["language"], b["text"], b["pack"]):
                row = {"path": path, "pack": pack, "rewrites": [], "nodes": [], "narrowed": False, "rewritten": False}
                try:
                    row |= parse_text(backends[pack], language, text)
                except Exception as e:  # a pack that can't be used is a row of each of its files
                    row["error"] = str(e)[:200]
                out.append([row.get(n) for n in _NAMES])
            yield pd.DataFrame(out, columns=_NAMES)

    return known.mapInPandas(run, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """(path, visit, start, end, line, excerpt) of all error nodes."""
    return parsed.select("path", F.explode("nodes").alias("n")).select("path", "n.*")


def parse_repository(files: DataFrame, packs: DataFrame, load: Load) -> tuple[DataFrame, DataFrame]:
    """(parsed files, diagnostics): a file with an error node is dropped whole; languages of programs without a pack are told once each."""
    parsed = parse(files, packs, load)
    sound = parsed.filter("error IS NULL AND size(nodes) = 0").drop("nodes", "error")
    broken = recorded.first_error(nodes_of(parsed)).select("path", "message")
    failed = parsed.filter("error IS NOT NULL").select("path", F.col("error").alias("message"))
    unread = files.filter("role = 'programming'").join(F.broadcast(packs.select("language").distinct()), "language", "left_anti")
    lacking = unread.groupBy("language").agg(F.min("path").alias("path"), F.count("*").alias("n")).select("path", F.concat(F.lit("no pack reads "), "language", F.lit(": "), "n", F.lit(" files")).alias("message"))
    return sound, broken.unionByName(failed).unionByName(lacking)


def matches(parsed: DataFrame, packs: DataFrame, load: Load, query: str) -> DataFrame:
    """(path, match, pattern, capture, start, end, text) of a named query over parsed files (path, pack, text).

    A name that a pack lacks is an error; what a match leaves unbound has no row, so that absence is an anti-join.
    """
    rows = [r.asDict(recursive=True) for r in packs.collect()]
    if lost := sorted(r["id"] for r in rows if query not in r["names"]):
        raise ValueError(f"no query {query} in {', '.join(lost)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backends = Backends(load, rows)
        for b in batches:
            out = []
            for path, pack, text in zip(b["path"], b["pack"], b["text"]):
                raw = text.encode()
                for i, (pattern, captures) in enumerate(backends[pack].query(query, raw)):
                    out += [[path, i, pattern, c, s, e, raw[s:e].decode("utf-8", "replace")] for c, (s, e) in captures.items()]
            yield pd.DataFrame(out, columns=["path", "match", "pattern", "capture", "start", "end", "text"])

    return parsed.select("path", "pack", "text").mapInPandas(run, "path string, match int, pattern int, capture string, start int, end int, text string")

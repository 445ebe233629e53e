"""Parser packs: manifests, digests, which pack reads which file, and what packs of a language say differently.

A pack is a folder with a manifest, a grammar and queries; its files come as rows (path, content). Packs that can't be used are
rows of errors. What a pack says is a small dimension; files meet it by broadcast joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions
from .classify import basename, extension, parent

MANIFEST, QUERIES, GRAMMAR = "parser.toml", "queries", "grammar.wasm"
# Fields of a manifest, and those that may be absent.
_TEXTS = ("id", "language", "version", "source", "revision", "license", "sha256", "comparison-domain")
_TABLES = {
    "files": ("extensions", "filenames"),
    "tokenization": ("ignored-node-kinds", "identifier-node-kinds", "literal-node-kinds", "unit-node-kinds"),
    "error-handling": ("propagation", "fallible-types", "optional-types", "non-failure-results", "non-failure-results-forms", "ambiguous-forms"),
    "tests": ("markers", "module-markers"),
}
_LISTS = [(t, k) for t, ks in _TABLES.items() for k in ks if k != "propagation"]
PACK = "root string, id string, language string, grammar_name string, version string, abi int, sha256 string, domain string, grammar_path string, propagation string, " + ", ".join(f"{k.replace('-', '_')} array<string>" for _, k in _LISTS) + ", error string"
_NAMES = [c.split()[0] for c in PACK.split(", ")]


def read_manifest(text: str) -> dict:
    """A manifest's fields; an unknown or missing field, another schema, an unsafe path or an odd selector raises."""
    import tomllib

    doc = tomllib.loads(text)
    known = {*_TEXTS, "schema", "abi", "grammar-name", "grammar-path", *_TABLES}
    if odd := [k for k in doc if k not in known] + [f"{t}.{k}" for t, ks in _TABLES.items() for k in doc.get(t, {}) if k not in ks]:
        raise ValueError(f"unknown field {odd[0]}")
    if lost := [k for k in _TEXTS if not isinstance(doc.get(k), str)]:
        raise ValueError(f"missing field {lost[0]}")
    if doc.get("schema") != 1:
        raise ValueError(f"unsupported schema {doc.get('schema')}")
    path = doc.get("grammar-path", GRAMMAR)
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"unsafe path {path}")
    lists = {k: doc.get(t, {}).get(k, []) for t, k in _LISTS}
    if any(not isinstance(v, list) or any(not isinstance(x, str) for x in v) for v in lists.values()):
        raise ValueError("a list of texts is due")
    for x in lists["extensions"]:
        if not x or x.startswith(".") or x != x.lower():
            raise ValueError(f"invalid selector {x}")
    for x in lists["filenames"]:
        if not x or "/" in x or x in (".", ".."):
            raise ValueError(f"invalid selector {x}")
    propagation = doc.get("error-handling", {}).get("propagation", "declared")
    if propagation not in ("declared", "unchecked"):
        raise ValueError(f"unknown propagation {propagation}")
    digest = doc["sha256"].lower()
    if not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("sha256 is not a digest")
    return {
        "id": doc["id"], "language": doc["language"], "grammar_name": doc.get("grammar-name", doc["language"]), "version": doc["version"], "abi": doc.get("abi"), "sha256": digest, "domain": doc["comparison-domain"],
        "grammar_path": path, "propagation": propagation, **{k.replace("-", "_"): v for k, v in lists.items()},
    }


def _manifests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for root, text in zip(b["root"], b["text"]):
            row = dict.fromkeys(_NAMES) | {"root": root} | {k.replace("-", "_"): [] for _, k in _LISTS}
            try:
                row |= read_manifest(text)
            except Exception as e:  # a broken manifest is a row
                row["error"] = str(e)[:200]
            rows.append([row[n] for n in _NAMES])
        yield pd.DataFrame(rows, columns=_NAMES)


def queries(contents: DataFrame) -> DataFrame:
    """(root, name, text) of every query file of a pack."""
    own = contents.filter(F.col("path").rlike(rf"(^|/){QUERIES}/[^/]+\.scm$"))
    root = parent(parent(F.col("path")))
    return own.select(root.alias("root"), F.regexp_replace(basename(F.col("path")), r"\.scm$", "").alias("name"), F.col("content").cast("string").alias("text"))


def queries_digest(named: DataFrame) -> DataFrame:
    """(root, names, queries_sha256): over name, zero, text, zero of the queries in the order of their names."""
    parts = F.array_sort(F.collect_list(F.struct("name", "text")))
    line = F.array_join(F.transform(parts, lambda q: F.concat(q["name"], F.lit("\0"), q["text"], F.lit("\0"))), "")
    return named.groupBy("root").agg(F.array_sort(F.collect_set("name")).alias("names"), F.sha2(line, 256).alias("queries_sha256"))


def discover(contents: DataFrame, search: list[str]) -> tuple[DataFrame, DataFrame]:
    """(packs, errors) of `contents` (path, content binary): each search path is a pack or a folder of packs.

    A pack is used if its manifest is sound, its language known and its grammar has the digest that it names. Of two packs of a
    language that claim a file alike the first stays, in the order of search paths, then names.
    """
    spark = contents.sparkSession
    paths = F.broadcast(spark.createDataFrame(list(enumerate(p.rstrip("/") for p in search)), "rank int, top string"))
    found = contents.filter(basename(F.col("path")) == MANIFEST).select(parent(F.col("path")).alias("root"), F.col("content").cast("string").alias("text"))
    heads = found.select("root").join(paths, (F.col("root") == F.col("top")) | (parent(F.col("root")) == F.col("top")))
    # A search path that is a pack itself is not searched further.
    own = heads.filter("root = top").select("top").distinct()
    heads = heads.join(own.withColumn("is_pack", F.lit(True)), "top", "left").filter("is_pack IS NULL OR root = top").groupBy("root").agg(F.min("rank").alias("rank"))
    read = found.join(heads.select("root"), "root").mapInPandas(_manifests, PACK).join(heads, "root")
    grammar = contents.select(F.col("path").alias("__grammar"), F.sha2("content", 256).alias("actual"))
    where = F.when(F.col("root") == "", F.col("grammar_path")).otherwise(F.concat_ws("/", "root", "grammar_path"))
    read = read.join(grammar, where == F.col("__grammar"), "left").drop("__grammar")
    known = F.broadcast(dimensions.languages(spark).select("language", F.lit(True).alias("known")))
    read = read.join(known, "language", "left").join(queries_digest(queries(contents)), "root", "left")
    why = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("known").isNull(), F.concat(F.lit("unknown language "), "language"))
        .when(F.col("actual").isNull(), F.lit("the grammar is missing"))
        .when(F.col("actual") != F.col("sha256"), F.lit("the grammar's digest differs"))
    )
    rated = read.withColumn("error", why).drop("actual", "known").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    sound = rated.filter("error IS NULL").drop("error")
    lost = overlaps(sound)
    errors = rated.filter("error IS NOT NULL").select("root", "error").unionByName(lost.select("root", F.concat(F.lit("claims the files of "), "first_id").alias("error")))
    return sound.join(lost.select("root"), "root", "left_anti"), errors


def _before() -> F.Column:
    return F.struct("a.rank", "a.root") < F.struct("b.rank", "b.root")


def _pairs(packs: DataFrame) -> DataFrame:
    return packs.alias("a").join(packs.alias("b"), (F.col("a.language") == F.col("b.language")) & _before())


def overlaps(packs: DataFrame) -> DataFrame:
    """(root, first_id): packs that claim a file that an earlier one of their language claims."""
    tails = lambda side: F.array_compact(F.transform(f"{side}.filenames", lambda n: F.nullif(F.lower(F.regexp_extract(n, r"^.+\.([^.]*)$", 1)), F.lit(""))))
    none = lambda side: (F.size(f"{side}.extensions") == 0) & (F.size(f"{side}.filenames") == 0)
    meet = (
        none("a") & none("b")
        | F.arrays_overlap("a.extensions", "b.extensions")
        | F.arrays_overlap("a.filenames", "b.filenames")
        | F.arrays_overlap(tails("a"), F.col("b.extensions"))
        | F.arrays_overlap(tails("b"), F.col("a.extensions"))
    )
    return _pairs(packs).filter(meet).groupBy(F.col("b.root").alias("root")).agg(F.min_by("a.id", F.struct("a.rank", "a.root")).alias("first_id"))


def differences(packs: DataFrame) -> DataFrame:
    """(first, second, difference): packs of one language with other queries, or else with other rules for errors."""
    handling = ["propagation", "fallible_types", "optional_types", "non_failure_results", "non_failure_results_forms", "ambiguous_forms"]
    missing = lambda one, other: F.when(F.size(F.array_except(f"{one}.names", f"{other}.names")) > 0, F.concat(F.col(f"{other}.id"), F.lit(" ships no "), F.array_join(F.array_except(f"{one}.names", f"{other}.names"), ", ")))
    lacking = F.concat_ws("; ", missing("a", "b"), missing("b", "a"))
    other = ~F.struct(*[f"a.{c}" for c in handling]).eqNullSafe(F.struct(*[f"b.{c}" for c in handling]))
    text = F.when(lacking != "", lacking).when(other, F.lit("they handle errors differently"))
    return _pairs(packs).select(F.col("a.id").alias("first"), F.col("b.id").alias("second"), text.alias("difference")).filter("difference IS NOT NULL")


def resolve(files: DataFrame, packs: DataFrame) -> DataFrame:
    """`files` (path, language) with the pack that reads each: one that names the file or its extension, else the language's general one."""
    first = lambda df, keys: df.groupBy(*keys).agg(F.min_by("id", F.struct("rank", "root")).alias("id"))
    by_name = first(packs.select("language", "id", "rank", "root", F.explode("filenames").alias("__name")), ["language", "__name"]).withColumnRenamed("id", "__p1")
    by_ext = first(packs.select("language", "id", "rank", "root", F.explode("extensions").alias("__ext")), ["language", "__ext"]).withColumnRenamed("id", "__p2")
    general = first(packs.filter((F.size("extensions") == 0) & (F.size("filenames") == 0)), ["language"]).withColumnRenamed("id", "__p3")
    out = files.withColumn("__name", basename(F.col("path"))).withColumn("__ext", extension(F.col("path")))
    out = out.join(F.broadcast(by_name), ["language", "__name"], "left").join(F.broadcast(by_ext), ["language", "__ext"], "left").join(F.broadcast(general), "language", "left")
    return out.select(*files.columns, F.coalesce("__p1", "__p2", "__p3").alias("pack"))


def vocabulary(packs: DataFrame) -> DataFrame:
    """(id, language, topic, word): what packs say about errors and tests, a row a word."""
    topics = ["fallible_types", "optional_types", "non_failure_results", "non_failure_results_forms", "ambiguous_forms", "markers", "module_markers"]
    named = lambda topic: F.transform(topic, lambda w: F.struct(F.lit(topic).alias("topic"), w.alias("word")))
    rows = F.explode(F.flatten(F.array(*map(named, topics), F.array(F.struct(F.lit("propagation").alias("topic"), F.col("propagation").alias("word"))))))
    return packs.select("id", "language", rows.alias("x")).select("id", "language", "x.*")

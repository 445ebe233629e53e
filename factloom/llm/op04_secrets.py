"""Secrets by an incremental blob ledger.

Every version of a text is a blob named by its SHA-256. The ledger holds (blob, rule version) pairs
that were scanned and what was found; only pairs it lacks are scanned, and findings go back to all
paths by an equi-join on the blob. Native: DataFrame operations only.

Edge cases: a null text is the empty blob; equal texts are one blob, scanned once; a null or repeated
path id is kept row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import span_sql
from .common import load, spread_join, whole
from .textspan import gaps_of, hits_of, joined, places

RULES_VERSION = "2026-01"
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "forge": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": r"-----BEGIN\x20(?:[A-Z0-9]+\x20){0,4}PRIVATE\x20KEY-----",
}
BASE = ("assign", "access", "hex")
KINDS = tuple(PATTERNS)
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = "blob string, rules string, spans " + SPANS


def _wanted(kind: str, text: Column) -> Column:
    if kind == "assign":
        return text.contains("=") | text.contains(":")
    return {"access": text.contains("AKIA"), "forge": text.contains("gh"), "jwt": text.contains("eyJ"), "pem": text.contains("-----BEGIN")}.get(kind, text.rlike("[0-9a-f]{32}"))


def _stands(kind: str, hit: Column) -> Column:
    if kind == "assign":  # what follows the sign and an optional quote has 8 characters or more
        return F.length(F.regexp_extract(hit, PATTERNS["assign"], 1)) >= 8
    return F.length(hit) >= 16 if kind == "access" else F.lit(True)


def scan(blobs: DataFrame) -> DataFrame:
    """`blobs` (blob, text) with `spans`: sorted by start, then kind as listed."""
    cols = {}
    for k in KINDS:
        want = _wanted(k, F.col("text"))
        cols[f"g_{k}"], cols[f"h_{k}"] = gaps_of(F.col("text"), PATTERNS[k], want), hits_of(F.col("text"), PATTERNS[k], want)
    df = blobs.withColumns(cols)

    def spans(rank: int, kind: str) -> Column:
        found = F.filter(places(F.col(f"g_{kind}"), F.col(f"h_{kind}"), 1), lambda s: _stands(kind, s["hit"]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    df = df.withColumns({f"s_{k}": spans(i, k) for i, k in enumerate(KINDS)})
    return df.select("blob", F.array_sort(F.concat(*[F.col(f"s_{k}") for k in KINDS])).cast(SPANS).alias("spans"))


def address(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of every row."""
    return docs.select(F.col(path).alias("path"), F.sha2(whole(text), 256).alias("blob"))


def update(ledger: DataFrame | None, docs: DataFrame, path: str = "doc_id", text: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """The rows that the ledger lacks for this rule version: (blob, rules, spans), each blob scanned once.

    Only hashes and ids are grouped. The one copy to be scanned is found by its id, so a text that a
    third of all rows share is moved as often as any other row, never gathered.
    """
    todo = address(docs, path, text).groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        todo = todo.join(ledger.filter(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    texts = docs.select(F.col(path).alias("path"), whole(text).alias("text")).withColumn("blob", F.sha2("text", 256))
    t, d = todo.alias("t"), texts.alias("d")
    # A path may be null or repeat: the blob tells its rows apart, and equal findings fold.
    picked = d.join(t.hint("shuffle_hash"), F.col("d.path").eqNullSafe(F.col("t.path")) & (F.col("d.blob") == F.col("t.blob")))
    found = scan(picked.select(F.col("t.blob").alias("blob"), F.col("d.text").alias("text")))
    return found.dropDuplicates(["blob"]).select("blob", F.lit(rules).alias("rules"), "spans")


def findings(docs: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """(path, blob, spans) of every row; rows without a finding have an empty array."""
    seen = ledger.filter((F.col("rules") == rules) & (F.size("spans") > 0)).select("blob", "spans")
    paths = address(docs, path, text)
    # A text that very many rows share is one row of the ledger.
    out = spread_join(paths, seen, ["blob"], paths.count(), "left")
    return out.select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, all spans."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, update(None, docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle_sql() -> str:
    """The same rows by a second engine."""
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    parts = [
        span_sql.spans("assign", 0, assign, f"length(regexp_extract(hit, {span_sql.quoted(assign)}, 1)) >= 8"),
        span_sql.spans("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 16"),
        span_sql.spans("hex", 2, "[0-9a-f]+", "length(hit) >= 32"),
        span_sql.spans("forge", 3, "gh[pousr]_[A-Za-z0-9]{36,}", lead="[^A-Za-z0-9_]|^"),
        span_sql.spans("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lead="[^A-Za-z0-9_-]|^"),
        span_sql.spans("pem", 5, r"-----BEGIN\x20(?:[A-Z0-9]+\x20){0,4}PRIVATE\x20KEY-----"),
    ]
    count = lambda i, k: f"count(*) filter (where rank = {i}) as n_{k}"
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents), f as (select *, s as o1, rank as o2 from ({' union all '.join(parts)}))
select t.doc_id, {', '.join(count(i, k) for i, k in enumerate(BASE))}, sha256({span_sql.joined('rank < 3')}) as base_sha256, {span_sql.joined('rank is not null')} as spans from t left join f using (doc_id) group by t.doc_id"""

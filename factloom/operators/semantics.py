"""Observations of compilers and checkers: union of units, rebasing, look-ups by span and id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("definitions", "references", "call_edges", "types", "implements", "gaps")
SPAN = ("path", "start_line", "start_column", "end_line", "end_column")
QUESTIONS = ("definitions", "references", "call_edges", "types", "implements")

Observations = dict[str, DataFrame]


def canonicalize(obs: Observations) -> Observations:
    """Every table without repeats; rows are a set, sorted only where they are written."""
    return {k: v.distinct() if k in TABLES else v for k, v in obs.items()}


def coverage(units: DataFrame) -> DataFrame:
    """One row: a question counts as asked only if every unit asked it."""
    return units.agg(*[F.bool_and(q).alias(q) for q in QUESTIONS])


def toolchain_gaps(units: DataFrame) -> DataFrame:
    """(message): one row for each unit whose toolchain isn't the first unit's."""
    first = units.agg(F.min_by("toolchain", "ordinal").alias("expected"))
    odd = units.crossJoin(F.broadcast(first)).filter(~F.col("toolchain").eqNullSafe(F.col("expected")))
    return odd.select(F.concat(F.lit("unit "), "unit", F.lit(" was observed with "), "toolchain", F.lit(" instead of "), "expected").alias("message"))


#: How a call finds its destination, from the most certain on; what isn't listed comes last.
DISPATCH = ("static", "virtual", "unmonomorphized", "unknown")


def dispatch_rank(dispatch: Column) -> Column:
    """The place of a dispatch in DISPATCH."""
    at = F.array_position(F.array(*map(F.lit, DISPATCH)), dispatch)
    return F.when(at > 0, at - 1).otherwise(len(DISPATCH) - 1).cast("int")


def provenance(units: DataFrame, unit: str) -> DataFrame:
    """One row: that of the first unit, under the name of the union."""
    first = units.agg(F.min_by(F.struct(*units.columns), "ordinal").alias("u")).filter("u IS NOT NULL").select("u.*")
    return first.withColumn("unit", F.lit(unit))


def merge(parts: list[Observations], unit: str | None = None) -> Observations | None:
    """The union of all parts; none of no part. Gaps tell of toolchains that differ; with `unit`, provenance is one row of that name."""
    if not parts:
        return None
    out = {k: reduce(DataFrame.unionByName, [p[k] for p in parts if k in p]) for k in (*TABLES, "units") if any(k in p for p in parts)}
    if "units" in out and "gaps" in out:
        odd = toolchain_gaps(out["units"])
        out["gaps"] = out["gaps"].unionByName(odd, allowMissingColumns=True)
    if unit is not None and "units" in out:
        out["provenance"] = provenance(out["units"], unit)
        out["coverage"] = coverage(out["units"])
    return canonicalize(out)


_SPAN = "span struct<path:string,start_line:int,start_column:int,end_line:int,end_column:int>"
#: A unit's observation as a JSON document, schema 1.
DOCUMENT = (
    "schema int, provenance struct<provider:string,provider_version:string,toolchain:string,unit:string>, coverage struct<definitions:boolean,references:boolean,call_edges:boolean,types:boolean,implements:boolean>, "
    f"definitions array<struct<id:string,kind:string,name:string,container:string,visibility:string,{_SPAN.replace(' ', ':', 1)}>>, references array<struct<{_SPAN.replace(' ', ':', 1)},resolves_to:string>>, "
    f"call_edges array<struct<{_SPAN.replace(' ', ':', 1)},`from`:string,to:array<string>,dispatch:string>>, types array<struct<{_SPAN.replace(' ', ':', 1)},type_ref:string>>, "
    f"implements array<struct<type_id:string,interface:string,{_SPAN.replace(' ', ':', 1)}>>, gaps array<struct<{_SPAN.replace(' ', ':', 1)},message:string>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of observations; files that are no such document are left to `bad_documents`."""
    return spark.read.schema(DOCUMENT + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.col("_metadata.file_path"))


def bad_documents(documents: DataFrame) -> DataFrame:
    """(file, message): files that can't be read, or are of another schema."""
    why = F.when(F.col("_corrupt").isNotNull(), "not a document of observations").when(~F.col("schema").eqNullSafe(F.lit(1)), F.concat(F.lit("unsupported schema "), F.coalesce(F.col("schema").cast("string"), F.lit("none"))))
    return documents.select("file", why.alias("message")).filter("message IS NOT NULL")


def tables(documents: DataFrame) -> Observations:
    """The tables of documents: spans become columns; units are in the order of their names."""
    ok = documents.filter("schema = 1 AND _corrupt IS NULL") if "_corrupt" in documents.columns else documents.filter("schema = 1")
    out: Observations = {}
    for name in TABLES:
        rows = ok.select(F.explode(name).alias("x")).select("x.*")
        out[name] = rows.select(*[c for c in rows.columns if c != "span"], *[F.col(f"span.{c}").alias(c) for c in SPAN])
    units = ok.select(F.col("provenance.unit").alias("unit"), F.col("provenance.toolchain").alias("toolchain"), "provenance.provider", "provenance.provider_version", *[F.col(f"coverage.{q}").alias(q) for q in QUESTIONS])
    place = F.row_number().over(Window.orderBy("unit")) - 1  # as many rows as units
    return out | {"units": units.withColumn("ordinal", place)}


def document(obs: Observations, unit: str) -> DataFrame:
    """Observations as one document row, rows sorted: what `write_documents` writes. A unit's rows fit in one file by its form."""
    parts = []
    for name in TABLES:
        rows = obs[name]
        item = F.struct(*[F.col(c) for c in rows.columns if c not in SPAN], F.when(F.col("path").isNotNull(), F.struct(*SPAN)).alias("span"))
        parts.append(rows.agg(F.array_sort(F.collect_list(item)).alias(name)))
    head = provenance(obs["units"], unit).select(F.lit(1).alias("schema"), F.struct("provider", "provider_version", "toolchain", "unit").alias("provenance"))
    asked = coverage(obs["units"]).select(F.struct(*QUESTIONS).alias("coverage"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [head, asked, *parts])  # one row each


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def _under(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root + "/")


def rebase(obs: Observations, root: str) -> Observations:
    """Paths relative to `root`, rows outside of it left out. Definitions without a span stay; implements and gaps aren't touched."""
    root = root.strip("/")
    if root in ("", "."):
        return canonicalize(obs)
    out = dict(obs)
    for name in ("definitions", "references", "call_edges", "types"):
        if name not in obs:
            continue
        spans = obs[name]
        keep = _under(F.col("path"), root) | (F.col("path").isNull() if name == "definitions" else F.lit(False))
        out[name] = spans.filter(keep).withColumn("path", F.substring("path", len(root) + 2, 1 << 20))
    return canonicalize(out)


def callees(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """`spans` (span columns) with each destination of the first edge that has exactly this span."""
    first = edges.groupBy(*SPAN).agg(F.min_by("to", F.struct("from", "to", "dispatch")).alias("to"))
    return spans.join(first, list(SPAN)).select(*spans.columns, F.explode("to").alias("callee"))


def calls_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that start in one of `ids` (id)."""
    return edges.join(ids.select(F.col("id").alias("from")).distinct(), "from", "left_semi")


def definition(definitions: DataFrame, ids: DataFrame) -> DataFrame:
    """One definition for each of `ids` (id), the first in canonical order."""
    cols = [c for c in definitions.columns if c != "id"]
    first = definitions.groupBy("id").agg(F.min(F.struct(*cols)).alias("d"))
    return ids.select("id").distinct().join(first, "id").select("id", "d.*")


def type_head(display: Column) -> Column:
    """A written type's head: without arguments and brackets; what isn't a name is anonymous."""
    bare = F.regexp_replace(F.regexp_replace(display, r"<.*$", ""), r"(\[\])+$", "")
    return F.when(display.endswith("[]"), "Array").when(bare.rlike(r"^[A-Za-z_$][A-Za-z0-9_$.]*$"), bare).otherwise("(anonymous)")


def package_of(path: Column) -> Column:
    """The package of a path below the last node_modules, scoped names as one; null outside."""
    name = F.regexp_extract(path, r"^(?:.*/)?node_modules/(@[^/]+/[^/]+|[^/@][^/]*)", 1)
    return F.when(name != "", name)


def entity_id(file: Column, qualified: Column, relative: Column, line: Column, column: Column) -> Column:
    """What a declaration is called in every project: lib: for the standard library, pkg: for packages, else where it stands (from 1)."""
    package = package_of(file)
    return (
        F.when(file.rlike(r"/lib\.[^/]*\.d\.ts$"), F.concat(F.lit("lib:"), qualified))
        .when(package.isNotNull(), F.concat_ws(":", F.lit("pkg"), package, qualified))
        .otherwise(F.concat_ws(":", relative, line + 1, column + 1))
    )

"""What can be told of recorded facts without a parser: compiler output, parse results, rows of a syntax observer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- compilers ----------------------------------------------------------------------------------------


def compiler(outputs: DataFrame) -> DataFrame:
    """(name, version, commit, host, sysroot, cfg, target_features, error) of what a compiler printed: (verbose, cfg, sysroot)."""
    field = lambda name: F.nullif(F.trim(F.regexp_extract("verbose", rf"(?m)^{name}:(.*)$", 1)), F.lit(""))
    words = F.split(F.trim(F.substring_index("verbose", "\n", 1)), r"\s+")
    version = F.coalesce(field("release"), F.get(words, F.lit(1)))
    lines = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("cfg", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "")))
    features = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, '^target_feature="(.*)"$', 1)), lambda x: x != "")
    root = F.regexp_replace("sysroot", r"^\s+|\s+$", "")
    error = F.when(version.isNull(), "no release in the version").when(field("host").isNull(), "no host in the version").when(root == "", "no sysroot")
    return outputs.select(F.lit("rustc").alias("name"), version.alias("version"), field("commit-hash").alias("commit"), field("host").alias("host"), root.alias("sysroot"), lines.alias("cfg"), features.alias("target_features"), error.alias("error"))


# ---- parse results ------------------------------------------------------------------------------------


def first_error(nodes: DataFrame) -> DataFrame:
    """(path, line, message) of the narrowest error node of each file, the first visited of equals: nodes (path, visit, start, end, line, excerpt)."""
    best = nodes.groupBy("path").agg(F.min_by(F.struct("line", "excerpt"), F.struct(F.col("end") - F.col("start"), "visit")).alias("e"))
    text = F.left(F.trim(F.substring_index("e.excerpt", "\n", 1)), F.lit(60))
    return best.select("path", "e.line", F.concat(F.lit("line "), F.col("e.line"), F.lit(": the grammar can't read `"), text, F.lit("`")).alias("message"))


def parse_rate(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: how much of `files` (path, bytes, units, rewritten) was read, error `nodes` (path, visit, start, end, ...) left out."""
    spans = nodes.groupBy("path", "start").agg(F.max("end").alias("end"))
    # Nested errors count once: what of a node lies behind all that began before it.
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    lost = spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("path").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).alias("lost"))
    rated = files.join(lost, "path", "left")
    bad = F.col("lost").isNotNull()
    return rated.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.count_if("rewritten").alias("rewritten"),
        F.count_if(bad).alias("errored"),
        F.coalesce(F.sum("lost"), F.lit(0)).alias("unreadable_bytes"),
        F.coalesce(F.sum(F.when(bad, F.col("bytes"))), F.lit(0)).alias("dropped_bytes"),
    ).withColumn("errored_percent", F.round(100 * F.col("errored") / F.greatest("files", F.lit(1)), 3))


def error_heads(nodes: DataFrame, top: int = 40) -> DataFrame:
    """(message, n): what first errors say, the most frequent first; a report of the top ones."""
    head = F.regexp_replace("message", "^line [0-9]+: ", "")
    return first_error(nodes).groupBy(head.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(top)


# ---- rows of a syntax observer ------------------------------------------------------------------------


def container_kind(node: Column, modifier: Column) -> Column:
    """struct, union (extern or packed), enum or opaque; null for other nodes."""
    kind = F.regexp_extract(node, "^(struct|union|enum|opaque)_declaration$", 1)
    marked = kind.isin("struct", "union") & modifier.isin("extern", "packed")
    return F.when(F.coalesce(marked, F.lit(False)), F.concat_ws(" ", modifier, kind)).when(kind != "", kind)


def is_extern(kind: Column) -> Column:
    return F.coalesce(kind.startswith("extern "), F.lit(False))


def is_receiver(container: Column, written: Column) -> Column:
    """Whether a first parameter's type is the container it stands in, by the last step of its name."""
    own = F.substring_index(container, ".", -1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(written, r"^[?*\[\]]+", ""), "^(const )+", ""))
    return F.coalesce((bare == "@This()") | (own != "") & (bare == own), F.lit(False))


def is_deinit(name: Column, container: Column, first_type: Column) -> Column:
    """Whether a function frees its receiver, by name and receiver."""
    return name.isin("deinit", "deinitAndFree", "destroy", "finalize") & is_receiver(container, first_type)


def receiver_tail(receiver: Column) -> Column:
    """The last step of what a method is called on, without pointer marks."""
    return F.regexp_replace(F.substring_index(receiver, ".", -1), r"^[?*&]+", "")


def local_container(written: Column, value: Column) -> Column:
    """The container that a local holds: its declared type without marks, else what its value constructs."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(written), r"^[?!]+", ""), r"^(?:[*?]|\[[^\]]*\]|const )+", ""))
    head = F.trim(F.substring_index(value, "{", 1))
    return F.when(F.coalesce(written, F.lit("")) != "", bare).when(value.contains("{") & head.rlike(r"^[\p{L}\p{N}_.]+$"), head)


def bound_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """`calls` (callee, index, text, ...) with the parameter (name, written) that each argument meets: equi-join on callee and place."""
    return calls.join(parameters.select("callee", "index", F.col("name").alias("parameter"), "written"), ["callee", "index"], "left")

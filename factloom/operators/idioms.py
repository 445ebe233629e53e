"""Relational idioms that many operators share: ancestors, nearest owner, first by rank, innermost interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def ancestors(path: Column, own: bool = True) -> Column:
    """array<struct<root, depth>>: every directory over a path, the empty root first; the path itself if `own`."""
    p = parts(path)
    n = F.size(p) if own else F.greatest(F.size(p) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.array_join(F.slice(p, 1, i), "/").alias("root"), i.alias("depth")))


def nearest_owner(items: DataFrame, path: str, owners: DataFrame, root: str, keep: list[str] | None = None) -> DataFrame:
    """`items` with the deepest owner whose root is the path or over it; without one, the owner's columns are null.

    Every ancestor is an equi-join key, so the work is a path's depth, not the number of owners.
    """
    keep = keep or [c for c in owners.columns if c != root]
    own = owners.select(F.col(root).alias("__root"), *keep)
    paths = items.select(F.col(path).alias("__path")).distinct()
    up = paths.select("__path", F.explode(ancestors(F.col("__path"))).alias("a")).select("__path", F.col("a.root").alias("__root"), F.col("a.depth").alias("__depth"))
    best = up.join(own, "__root").groupBy("__path").agg(F.max_by(F.struct("__root", *keep), F.struct("__depth", *keep)).alias("o"))
    out = items.join(best, F.col(path) == F.col("__path"), "left")
    return out.select(*items.columns, F.col("o.__root").alias("owner_root"), *[F.col(f"o.{c}").alias(c) for c in keep])


def first_by_rank(df: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """Of each key the value with the least rank; ties go to the least value."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(rank, value)).alias(value))


#: Dyadic levels of places: up to 2 ** LEVELS.
LEVELS = 48


def innermost(inner: DataFrame, outer: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """`inner` (on, start, end), each once, with the narrowest interval of `outer` (on, start, end, id) around it; places from 0 on.

    An outer interval is cut into dyadic blocks, at most two a level; an inner one looks up the block of each level that its start is
    in. So it meets, by an equi-join, just the intervals that its start is in, not all of its file.
    """
    half = lambda c, k: F.floor(c / F.pow(F.lit(2), k)).cast("long")
    low = lambda k: -half(-F.col("start"), k)
    high = lambda k: half(F.col("end") + 1, k)
    block = lambda k, n: F.struct(k.cast("int").alias("level"), n.alias("block"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)),
        lambda k: F.when(low(k) < high(k), F.array_compact(F.array(F.when(low(k) % 2 == 1, block(k, low(k))), F.when(high(k) % 2 == 1, block(k, high(k) - 1))))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>")),
    )
    parts = outer.select(*on, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("id").alias("__id"), F.explode(F.flatten(blocks)).alias("__b")).select(*on, "__s", "__e", "__id", "__b.*")
    levels = sorted(r[0] for r in parts.select("level").distinct().collect())  # at most LEVELS + 1
    if not levels:
        return inner.distinct().withColumn("around", F.lit(None).cast(outer.schema["id"].dataType))
    at = F.explode(F.array(*[block(F.lit(k), half(F.col("start"), F.lit(k))) for k in levels])).alias("__b")
    met = inner.distinct().select("*", at).select(*inner.columns, "__b.*").join(parts, [*on, "level", "block"])
    fits = F.col("end") <= F.col("__e")
    if strict:
        fits = fits & ((F.col("end") - F.col("start")) < (F.col("__e") - F.col("__s")))
    best = met.filter(fits).groupBy(*inner.columns).agg(F.min_by("__id", F.struct(F.col("__e") - F.col("__s"), "__id")).alias("around"))
    return inner.distinct().join(best, inner.columns, "left")


def with_marker(directories: DataFrame, files: DataFrame, markers: DataFrame) -> DataFrame:
    """The `directories` (path) over or in which a marker file of their name stands: markers (name, marker), a null marker for names that need none.

    Every folder over a directory is a key, and so is the file's own folder: two equi-joins.
    """
    named = directories.select("path", F.substring_index("path", "/", -1).alias("name")).join(F.broadcast(markers), "name")
    over = named.filter("marker IS NOT NULL").select("path", "marker", F.explode(ancestors(F.col("path"), own=False)).alias("a")).select("path", "marker", F.col("a.root").alias("folder"))
    p = F.split(files["path"], "/")
    at = files.select(F.array_join(F.slice(p, 1, F.size(p) - 1), "/").alias("folder"), F.get(p, F.size(p) - 1).alias("marker"))
    marked = over.join(at, ["folder", "marker"], "left_semi").select("path")
    return directories.join(marked.unionByName(named.filter("marker IS NULL").select("path")).distinct(), "path", "left_semi")


def normalize_relative(base: Column, path: Column) -> Column:
    """base/path with '.' and '..' resolved by the letters alone."""
    steps = F.filter(F.concat(parts(base), F.split(path, "/")), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.array_join(walked, "/")


def package_id(kind: Column, root: Column) -> Column:
    """kind:root, the topmost root written as a dot."""
    return F.concat_ws(":", kind, F.when(root == "", F.lit(".")).otherwise(root))


def path_key(path: Column) -> Column:
    """What paths sort by: their components."""
    return F.split(path, "/")

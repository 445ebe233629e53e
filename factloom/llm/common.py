"""What the operators of this subpackage share: shared scratch tables, Arrow maps, hashing helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column | str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with as many underscores behind it as `df` needs to have no such column."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if Spark runs in this process alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "factloom-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/factloom"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as zstd Parquet and read it back.

    The written table survives a lost executor. Shuffle files of the write are removed as it ends.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = written(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


_written_paths: list[str] = []


def written(path: str) -> str:
    """`path`, remembered for `clear`."""
    _written_paths.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Removes the tables that the operators of this application have written to the shared folder; results not yet read go too."""
    jvm, conf, n = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written_paths:
        where = jvm.org.apache.hadoop.fs.Path(_written_paths.pop())
        n += where.getFileSystem(conf).delete(where, True)
    return n


class Scratch:
    """Named tables in the shared folder, of which the outdated ones can be removed early."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df`; an earlier table of that name is removed afterwards."""
        old = self.paths.get(name)
        out, self.paths[name] = _written(df, name)
        if old:
            self.remove(old)
        return out

    def drop(self, name: str) -> None:
        if name in self.paths:
            self.remove(self.paths.pop(name))

    def remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


_kept: dict[str, object] = {}


def kept(token: str, make: Callable[[], object]) -> object:
    """What `make` makes, kept by this Python worker for later tasks; only the last two tokens are."""
    if token not in _kept:
        while len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[token] = make()
    return _kept[token]


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of at most 8 MB, unless one row is longer."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`f` over Arrow batches; batches it answers with None are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: A key counts as hot from 1/HOT of all rows, and LEAST_HOT rows, on.
HOT, LEAST_HOT = 512, 64


def spread_join(refs: DataFrame, other: DataFrame, keys: list[str], total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """The equi-join of `refs` (`total` rows) and `other` on non-null keys, `how` being inner, left or left_semi.

    Rows of `refs` with a hot key meet their part of `other` by broadcast: there are fewer than HOT such keys (they are
    looked up at once, in `counts` with their number n if given), and `other` is to hold a bounded number of rows for
    each. No task gathers the rows of a key. Without a hot key this is a plain join.
    """
    if counts is None:
        counts = refs.groupBy(*keys).agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") > max(LEAST_HOT, total // HOT)).select(*keys).collect() if total > LEAST_HOT else []
    if not found:
        return refs.join(other.hint("merge"), keys, how)
    hot = F.broadcast(refs.sparkSession.createDataFrame(found, refs.select(*keys).schema))
    usual = refs.join(hot, keys, "left_anti").join(other.hint("merge"), keys, how)
    crowded = refs.join(hot, keys, "left_semi").join(F.broadcast(other.join(hot, keys, "left_semi")), keys, how)
    return usual.unionByName(crowded)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

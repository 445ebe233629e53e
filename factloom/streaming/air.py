"""Dumps that arrive as files: each file is whole in one micro-batch, so the batch reader applies to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import air


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of new files under `path`."""
    whole = spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return cut.select("file", F.col("line_no").cast("long").alias("line_no"), "value")


def _stored(spark: SparkSession, out: str, batch: int) -> int:
    """How many functions the batches before hold."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{out}/functions").filter(F.col("batch") < batch).count()
    except AnalysisException:  # nothing is stored yet
        return 0


def store_stream(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes functions and instructions of each batch under `out`, one folder a batch, so that a replay overwrites it.

    Functions are numbered from 0 over the whole store: a batch goes on after those before it.
    """

    def write(batch: DataFrame, n: int) -> None:
        base = _stored(batch.sparkSession, out, n)
        for name, df in zip(("functions", "instructions"), air.numbered(air.classify(batch))):
            df.withColumn("id", F.col("id") + base).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch={n}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

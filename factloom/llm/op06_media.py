"""Media columns: content-defined chunks of a payload, stored once, put together again and verified.

A text's UTF-8 bytes, padded to 64, are the samples of an 8-bit mono WAV. A rolling gear hash cuts the
samples into chunks; digests of all chunks meet in a Spark aggregation, each different chunk is stored
once, in files bucketed by digest, and every row keeps its file's head and its ordered list of digests.
Reading back joins the lists to the stored chunks, puts head and chunks in order, checks the payload's digest
and computes features of the bytes read. Both tables lie in the shared folder.

Rows of one chunk, the most by far, are whole after the join; only longer ones are grouped by content. Chunks, and
long contents, that very many rows share (see common.spread_join) are joined by
broadcast, so that no task gathers them.

Edge cases: a null or empty text is 64 zero bytes; equal texts share all chunks and give equal values; texts that
differ by trailing zero bytes alone share the payload, not the length; null or repeated keys are kept row by row;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, arrow_map, load, shared_dir, spread_join, stored, union_all, whole, written

LEAST, MASK_BITS, MOST = 4096, 14, 65536
UNIT = 64
BUCKET_BYTES = 16 << 20
#: Chunks are moved and stored in so many turns, by digest: no more of them than that share lies on disks twice.
ROUNDS = 2
RATE = 8000
_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload(text: bytes) -> bytes:
    """The bytes, zero-padded to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or UNIT * (not text))


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks: where the gear hash of the 32 bytes before is zero in its high bits."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def header(n: int) -> bytes:
    """The head of an 8-bit mono WAV of n samples."""
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def feature(samples: bytes) -> str:
    """Mean, deviation, zero crossings and the energy in eight bands of amplitude, of unsigned samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    sums = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    mean = sums[0] / len(x)
    dev = max(0.0, sums[1] / len(x) - mean * mean) ** 0.5
    cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{mean:.4f}|{dev:.4f}|{cross}|" + ",".join(map(str, counts.tolist()))


def lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, sha, head, digests): every row's media as its head and an ordered list of chunk digests."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, head, digests = [], [], [], []
        for t in b.column(1):
            raw = t.as_py()
            data = payload(raw)
            n.append(len(raw))
            sha.append(hashlib.sha256(data).digest())
            head.append(header(len(data)))
            digests.append([hashlib.sha256(c).digest() for c in chunks(data)])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(head, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], names=["key", "n_bytes", "sha", "head", "digests"])

    rows = docs.select(F.col(key).alias("key"), whole(text).cast("binary").alias("t"))
    return arrow_map(rows, run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, sha binary, head binary, digests array<binary>")


def pieces(docs: DataFrame, text: str, turn: int) -> DataFrame:
    """(digest, z): the chunks whose turn it is, deflated by zstandard; a batch's repeats are left out at once."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        squeeze, seen = zstandard.ZstdCompressor(level=3), {}
        for t in b.column(0):
            for c in chunks(payload(t.as_py())):
                d = hashlib.sha256(c).digest()
                if d[0] % ROUNDS == turn and d not in seen:
                    seen[d] = squeeze.compress(c)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "z"])

    return arrow_map(docs.select(whole(text).cast("binary").alias("t")), run, "digest binary, z binary")


def store_chunks(docs: DataFrame, text: str, n_bytes: int) -> DataFrame:
    """The chunk store: every different chunk once, in files of the shared folder bucketed by digest."""
    spark = docs.sparkSession
    n = max(2, -(-n_bytes // BUCKET_BYTES))
    name = f"media_chunks_{uuid.uuid4().hex}"
    path = written(f"{shared_dir(spark)}/{name}")
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        for turn in range(ROUNDS):
            once = pieces(docs, text, turn).repartition(n, "digest").groupBy("digest").agg(F.first("z").alias("z"))
            once.write.mode("append").bucketBy(n, "digest").option("compression", "none").option("path", path).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, was)
    store = spark.table(name)
    store.schema  # the files stay; only the name, which the bucketing needed, goes
    spark.sql(f"DROP TABLE {name}")
    return store


def read_back(rows: DataFrame, store: DataFrame) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from stored heads and chunks."""
    kind = rows.schema["key"].dataType.simpleString()
    n_rows, n_refs = rows.agg(F.count("*"), F.sum(F.size("digests"))).first()
    place = ["key", "n_bytes", "sha", "head", "parts"]
    one = rows.filter(F.size("digests") == 1).select("key", "n_bytes", "sha", "head", F.lit(1).alias("parts"), F.lit(0).alias("ord"), F.col("digests")[0].alias("digest"))
    # Rows of equal content and length are equal in all that is returned: they are put together once.
    long_rows = rows.filter(F.size("digests") > 1)
    many = long_rows.groupBy("sha", "n_bytes").agg(F.first("head").alias("head"), F.first("digests").alias("digests"))
    many = many.select(F.lit(None).cast(kind).alias("key"), "n_bytes", "sha", "head", F.size("digests").alias("parts"), F.posexplode("digests").alias("ord", "digest"))
    single = spread_join(one, store, ["digest"], n_refs or 0).select(*place, F.array(F.struct("ord", "z")).alias("zs"))
    long = spread_join(many, store, ["digest"], n_refs or 0).groupBy("sha", "n_bytes").agg(F.first("key").alias("key"), F.first("head").alias("head"), F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("ord", "z"))).alias("zs"))
    outs = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        out: list[list] = [[] for _ in range(7)]
        cols = {c: b.column(i) for i, c in enumerate(b.schema.names)}
        for n, sha, head, parts, zs in zip(*(cols[c].to_pylist() for c in ("n_bytes", "sha", "head", "parts")), cols["zs"]):
            listed = zs.as_py()
            data = b"".join(open_.decompress(x["z"]) for x in listed)
            digest = hashlib.sha256(data)
            if len(listed) != parts or digest.digest() != sha:
                raise ValueError(f"stored media of {n} bytes differ from what was written")
            media = hashlib.sha256(head)
            media.update(data)
            for c, v in zip(out, (n, len(data), digest.hexdigest(), zlib.crc32(data[-UNIT:]), len(head) + len(data), media.hexdigest(), feature(data))):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([cols["key"], cols["sha"], *[pa.array(v, t) for v, t in zip(out, types)]], names=["key", "sha", *[x.split()[0] for x in outs.split(", ")]])

    schema = f"key {kind}, sha binary, {outs}"
    whole_single = arrow_map(single.select(*place, "zs"), run, schema).drop("sha")
    # A row of digests and features for each long content: little, but much work to make.
    whole_long = stored(arrow_map(long.select(*place, "zs"), run, schema).drop("key"), "media-long")
    whole_many = spread_join(long_rows.select("key", "n_bytes", "sha"), whole_long, ["sha", "n_bytes"], n_rows).drop("sha")
    return union_all([whole_single, whole_many])


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every row's media in chunks, read them back, and return what `read_back` computes."""
    rows = stored(lists(docs, key, text), "media-lists")
    n_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    return read_back(rows, store_chunks(docs, text, n_bytes)).withColumnRenamed("key", key)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: digests and features of its media, as read back from the store."""
    return round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"))

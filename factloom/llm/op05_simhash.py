"""Near-duplicates by SimHash fingerprints and a segment-popcount grid.

A fingerprint is cut into segments, each embedded as its bit count: in either half 8 segments of 2 bits
and 16 of 1 bit. The Manhattan distance of two embeddings is a lower bound of the Hamming distance, so
fingerprints that differ in at most 4 bits have a half within Manhattan distance 2. Two such halves share
a grid cell among those at distance 1 or less of either: each fingerprint enters the about 29 cells around
each of its halves, and an equi-join on the cell finds the candidates, verified by the exact count of
differing bits. A half's embedding carries 28 bits, so cells are rarely shared by chance.

Dense cells (more than DENSE members) are linked without pairs: fingerprints that differ in 4 bits or
fewer have one between them, at 2 bits or fewer from both. Every member enters its 2081 neighbours at
2 bits or fewer; all that meet at one are within 4 bits of one another, and a star links them. That is
exact, and grows with the members alone.

Edge cases: null or empty texts have fingerprint zero and link like any other; texts of under four
words are one shingle; equal fingerprints are one vertex, whatever ids they have, so that repeated rows and
repeated ids link nothing else; component_id is the least id of a class that isn't null, null if there is none;
empty tables give empty results.

Both ways through a cell are exact at every size: DENSE only says which costs less.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, free_name, load, spread_join, stored, union_all, whole
from .components import components

WORDS = 4
DISTANCE = 4
SEED = 42
DENSE = 48
#: Segments of 2 bits in a half, and the bits that they take.
PAIRS = 8
PAIRED = (1 << 2 * PAIRS) - 1
BLOCK = 1 << 15
#: Cells of a fingerprint, about.
CELLS = 58


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a text's lower-cased word shingles, repeats included."""
    import xxhash

    parts = text.lower().split()  # bytes: lowers A-Z only, splits at space and 09 to 0D
    if not parts:
        return 0
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    line = b" ".join(parts)
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    spans = list(zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()))
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(spans), BLOCK):
        part = np.array([h(line[a:b], SEED) for a, b in spans[i : i + BLOCK]], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): fp is a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), whole(text).cast("binary").alias("text"))
    return arrow_map(rows, run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _half_cells(half: Column, side: int) -> Column:
    """The cells around a half: its segments' bit counts packed, one of them moved by one at most."""
    low = half.bitwiseAND(F.lit(PAIRED))
    counts = low.bitwiseAND(F.lit(0x55555555)) + F.shiftright(low, 1).bitwiseAND(F.lit(0x55555555))
    packed = counts.bitwiseOR(half.bitwiseAND(F.lit(0xFFFFFFFF ^ PAIRED)))
    moved = [packed]
    for s in range(0, PAIRS * 2, 2):
        count = F.shiftright(counts, s).bitwiseAND(F.lit(3))
        moved += [F.when(count < 2, packed + F.lit(1 << s)), F.when(count > 0, packed - F.lit(1 << s))]
    moved += [packed.bitwiseXOR(F.lit(1 << b)) for b in range(PAIRS * 2, 32)]
    return F.array_compact(F.array(*[m * 2 + side for m in moved]))


def cells(fp: Column) -> Column:
    """All grid cells of a fingerprint, the half they belong to in the lowest bit."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return F.concat(_half_cells(low, 0), _half_cells(high, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near_masks() -> list[int]:
    one = [1 << i for i in range(64)]
    return [0, *map(_signed, one), *(_signed(a | b) for a, b in combinations(one, 2))]


def links(fps: DataFrame, dense: int = DENSE, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints of `fps` (fp, distinct) that join all that belong together."""
    if distance != DISTANCE:
        raise ValueError("the grid is laid out for 4 differing bits")
    rows = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    # Only cells with company matter; a member of a dense cell is told apart by the count.
    crowds = stored(rows.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-crowds")
    members = stored(spread_join(rows, crowds, ["cell"], CELLS * fps.count(), counts=crowds), "simhash-cells")
    few = members.filter(F.col("n") <= dense).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = lambda x, y: (F.bit_count(x.bitwiseXOR(y)) <= distance) & (x < y)
    pairs = few.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda y: near(F.col("a"), y))).alias("b"))
    crowd = members.filter(F.col("n") > dense).select("fp").distinct()
    masks = F.array(*[F.lit(m) for m in _near_masks()])
    around = crowd.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))
    heads = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("mid", "a")
    stars = around.join(heads.hint("merge"), "mid").filter("fp != a").select("a", F.col("fp").alias("b"))
    return union_all([pairs, stars]).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): one row per document; equal component_id means near-duplicates."""
    rows = stored(fingerprints(docs, key, text), "simhash-fps")
    named = _named(rows, key)
    return spread_join(rows, named, ["fp"], rows.count()).select(key, "fp", "component_id")


def _named(rows: DataFrame, key: str) -> DataFrame:
    """(fp, root, component_id) of each different fingerprint: its class, and the least id in it."""
    reps = stored(rows.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-reps")
    ab = links(reps.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(ab, Scratch(rows.sparkSession)).withColumnRenamed("u", "fp")
    linked = reps.join(roots.hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    return spread_join(linked, least, ["root"], reps.count()).select("fp", "root", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without near-duplicates: of each class one row stays, the one with the least id.

    Null ids come last; of rows with the same id, the one whose text has the least hash stays; of rows that are also
    equal in that, any one. The other columns pass unchanged, whatever their names.
    """
    name = lambda x: free_name(docs, x)
    k, h, id_ = name("__key"), name("__hash"), name("__id")
    content = F.xxhash64(whole(text))
    rows = docs.select(F.struct(F.col(key).alias("id"), content.alias("hash")).alias("row"), whole(text).alias("text"))
    rows = stored(fingerprints(rows, "row", "text"), "simhash-fps").select(F.col("row.id").alias("id"), F.col("row.hash").alias("hash"), "fp")
    named = _named(rows, "id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("hash").alias("hash")))
    heads = spread_join(rows, named.select("fp", "root"), ["fp"], rows.count()).groupBy("root").agg(first.alias("x"))
    heads = heads.select(F.col("x.id").alias(id_), F.xxhash64("x.id", "x.none").alias(k), F.col("x.hash").alias(h)).distinct()
    keyed = docs.withColumns({k: F.xxhash64(F.col(key), F.col(key).isNull()), h: content})
    met = keyed.join(heads.hint("merge"), [k, h]).filter(F.col(key).eqNullSafe(F.col(id_)))
    # Rows that repeat id and text: only those that do meet in an aggregation.
    once = met.groupBy(k, h).agg(*[F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")])
    return once.select("__row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the least doc_id that links reach."""
    out = classes(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Token ids in directly addressable codes.

Ids are cut into bytes. Level 0 holds the low byte of every id, level 1 the second byte of those ids
that have one, and so on; each level has a bitmap that says which of its entries go on, and a rank
directory (set bits before every 512th entry) that tells where an entry goes on in the next level. Any id
of a shard is read with a few look-ups, and no block is decoded.

Shards hold whole documents, about SHARD ids, and are rows of a Parquet table in the shared folder:
(part, seq, ids of the part before it, number of documents and ids, keys, sizes, image). Documents are in ascending key order over
all shards. Reading back walks the shards; only one number per part (a Spark partition) is gathered to
place each shard in the whole.

Edge cases: a null or empty text holds the end id alone; documents of equal or null key are kept, nulls
first, each with its own place; an empty table gives an empty result; a shard is never split, so that a
very long text is a long shard. Added tokens in a text, such as an end mark written out, get their own id,
as the library's plain call gives it.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, kept, load, small_batches, stored, whole
from .ragged import coded, gathered

END = 2
SHARD = 1 << 20
STEP = 512
#: Bytes of words and ids that a worker keeps, and what an entry takes besides.
MEMO_BYTES, ENTRY = 192 << 20, 200
#: Parts that are encoded as one text.
LINES = 4096
MAGIC = b"DAC1"
_WHITE = r"\s\u180e\u200b\ufeff"
#: A space inside or at either end of a run of white space.
_RUN = re.compile(f" (?=[{_WHITE}]|\\Z)(?<![^{_WHITE}] )")
#: What may stand as a line of its own: no white space but a space at its head.
_LINE = re.compile(f" ?[^{_WHITE}]+")
#: A Latin letter and a mark after it: the library cuts between them too.
_MARKS = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?%$&*\n])"


class Encoder:
    """The tokenizers library over a file of byte-level BPE, called as it stands; ids of words that it has met are kept.

    A text is cut before single spaces, where no token ever reaches across: the library cuts there itself, and added
    tokens hold no space. Texts in which a space stands between white space, and so might belong to a run, are encoded
    whole. Of a batch each different word is looked up once; it is cut once more between a letter and a mark after it.
    Parts not met before go to the library as lines of one text, which is the same and costs half.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = newline[0] if len(newline) == 1 else None
        self.cuts = not any(" " in t or "\n" in t for t in added)
        self.parts: dict[str, bytes] = {}
        self.room = MEMO_BYTES

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts not met before."""
        plain = [p for p in parts if self.newline is not None and _LINE.fullmatch(p)]
        out: dict[str, bytes] = {}
        for i in range(0, len(plain), LINES):
            some = plain[i : i + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.newline).tolist()
            if len(ends) == len(some) - 1:
                raw = ids.tobytes()
                out.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, [0, *(e + 1 for e in ends)], [*ends, len(ids)]))
        rest = [p for p in parts if p not in out]
        return out | dict(zip(rest, self.whole(rest)))

    def table(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each of the different parts has, the ids of all of them); they are kept while there is room."""
        got = list(map(self.parts.get, parts))
        lacking = [i for i, x in enumerate(got) if x is None]
        if lacking:
            fresh = self.fresh([parts[i] for i in lacking])
            for i in lacking:
                got[i] = fresh[parts[i]]
            if self.room > 0:  # parts that are met early are the frequent ones
                self.room -= sum(ENTRY + len(p) + len(x) for p, x in fresh.items())
                self.parts.update(fresh)
        return np.array(list(map(len, got)), np.int64) // 4, np.frombuffer(b"".join(got), "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, the ids of all of them)."""
        was = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and to walk over all known words takes a third of the time
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if not self.cuts or _RUN.search(t.as_py())]
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            apart = [np.frombuffer(x, "<u4") for x in self.whole(texts.filter(pa.array(mask)).to_pylist())]
            sizes, ids = self.cut(texts.filter(pa.array(~mask)))
            parts = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
            own = iter(apart)
            every = [next(own) if m else next(parts) for m in mask.tolist()]
            return np.array([len(x) for x in every]), np.concatenate(every)
        return self.cut(texts)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts to words, different words to parts, different parts to ids; and back."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        heads, which, words = coded(pc.split_pattern(texts, " "))
        # The first word of a text has no space before it.
        first = {k: i for i, k in enumerate(dict.fromkeys(which[heads].tolist()))}
        which[heads] = [len(words) + first[k] for k in which[heads].tolist()]
        lists = pc.split_pattern(pc.replace_substring_regex(pa.concat_arrays([words, words.take(pa.array(list(first)))]), _MARKS, r"\1 \2"), " ")
        spaced = np.zeros(len(lists.flatten()), bool)
        counts = lists.value_lengths().to_numpy()
        begun = np.cumsum(counts) - counts
        spaced[begun[: len(words)]] = True
        parts = pc.binary_join_element_wise(pa.array(np.where(spaced, " ", "")), lists.flatten(), "").dictionary_encode()
        size, ids = self.table(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        size, ids = gathered(size, ids, parts.indices.to_numpy())
        size, ids = gathered(np.add.reduceat(size, begun), ids, which)
        return np.add.reduceat(size, heads), ids


def pack(ids: np.ndarray) -> bytes:
    """The image of a run of ids: magic, number of levels, and of each level its length, bytes, bitmap, ranks."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        on = rest > 255
        ranks = np.concatenate(([0], np.cumsum(on)[STEP - 1 :: STEP])).astype("<u4") if len(rest) else np.zeros(1, "<u4")
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), np.packbits(on, bitorder="little").tobytes(), ranks.tobytes()))
        if not on.any():
            break
        rest = rest[on] >> np.uint32(8)
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<IIII", n, len(a), len(b), len(c)) + a + b + c for n, a, b, c in levels)


class Image:
    """A packed run of ids, read in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not an image of directly addressable codes")
        (n,), at, self.levels = struct.unpack_from("<I", data, 4), 8, []
        for _ in range(n):
            count, a, b, c = struct.unpack_from("<IIII", data, at)
            at += 16
            self.levels.append((count, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b)))
            at += a + b + c

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        """Any id, from one byte, one bit and one rank a level."""
        value = 0
        for k, (_, low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            a = i // STEP
            before = bits[a * STEP // 8 : (i >> 3) + 1].copy()
            before[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[a]) + int(np.bitwise_count(before).sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(len(self), np.uint32)
        where = slice(None)
        for k, (n, low, bits, _) in enumerate(self.levels):
            out[where] |= low.astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits, count=n, bitorder="little").astype(bool)
            where = np.flatnonzero(on) if k == 0 else where[on]
        return out


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored shards of `docs`: (part, seq, before, n_docs, n_ids, keys, sizes, image), in key order."""
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    names = ["part", "seq", "before", "n_docs", "n_ids", "keys", "sizes", "image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), None, 0
        keys: list = []
        ids: list[bytes] = []
        size = before = 0

        def shard() -> pa.RecordBatch:
            values = [part, seq, before, len(keys), size, keys, [len(x) // 4 for x in ids], pack(np.frombuffer(b"".join(ids), "<u4"))]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(arrow), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for b in batches:
            encoder = encoder or kept(f"encoder {path}", lambda: Encoder(path))
            sizes, flat = encoder.encode(b.column(1))
            raw, at = memoryview(flat.tobytes()), 0
            for k, n in zip(b.column(0).to_pylist(), sizes.tolist()):
                keys.append(k)
                ids.append(bytes(raw[4 * at : 4 * (at + n)]) + struct.pack("<I", END))
                at += n
                size += n + 1
                if size >= SHARD:
                    yield shard()
                    before += size
                    keys, ids, size, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), whole(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    made = rows.mapInArrow(run, f"part int, seq long, before long, n_docs long, n_ids long, keys array<{kind.simpleString()}>, sizes array<long>, image binary")
    return stored(made, "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the stored images."""
    kind = shards.schema["keys"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part, as many as Spark partitions wrote: their running sum is a small window.
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, starts, counts, sums = [], [], [], []
        for at, ks, ns, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            raw, place = memoryview(Image(image.as_py()).all().astype("<u4").tobytes()), 0
            for k, n in zip(ks, ns):
                keys.append(k)
                starts.append(at + place)
                counts.append(n)
                sums.append(zlib.crc32(raw[4 * place : 4 * (place + n)]))
                place += n
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("at"), "keys", "sizes", "image")
    return arrow_map(placed, run, f"key {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: where its ids start, how many they are and their checksum, as read back."""
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json"))).withColumnRenamed("key", "doc_id")

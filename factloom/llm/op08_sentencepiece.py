"""SentencePiece encoding and decoding by a relational lattice.

Words of the corpus are counted; the substrings of the frequent ones, of bounded length, are exploded
and equi-joined to the piece table; the edges found are grouped by word, and a fold with Spark's
higher-order functions makes the word's ids of them. Two folds read the same lattice:

* `viterbi` keeps the best-scored path to every place: right for unigram models.
* `merge` joins the best-scored neighbours again and again: right for BPE models.

Which one is right is the model's own type. With a BPE model the best path by Viterbi isn't what
the library returns, so `op8` folds by `merge` (piece_bpe_32k.model is a BPE model).

Frequent words (at most DICTIONARY, a bound on what is broadcast, and no longer than LONGEST) come from
the lattice; each other word goes through the same merge rule where it is met, with the same result.
A word is a run of spaces and what follows up to the next; line feeds stand alone; no piece crosses these.

Edge cases: null or empty texts have no ids; characters without a piece become their UTF-8 bytes; words
of any length cost n log n; ties of scores go to the leftmost pair; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, free_name, kept, load, stored, whole
from .ragged import coded, gathered

SPACE = "▁"
DICTIONARY = 200_000
LONGEST = 32
#: Bytes of words and ids that a worker keeps, and what an entry takes besides.
MEMO_BYTES, ENTRY = 48 << 20, 200
#: Texts that are taken together.
SLICE = 256
#: Characters of a word up to which a scan for the best pair costs less than a heap.
SHORT = 48
TASKS = 48
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
#: Texts in which more than one space may belong to a word.
_RUNS = re.compile(f"  |{SPACE}|\\A | \\Z")


def read_model(path: str) -> dict:
    """The piece table of a model file: {pieces: [(piece, id, score)], unknown id, first byte id or None, space prefix}."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    first = next((i for i in range(n) if sp.is_byte(i)), None)
    return {"pieces": [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(n) if i not in special], "unknown": sp.unk_id(), "bytes": first, "size": n}


def frequent(docs: DataFrame, text: str, most: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """(word): the words that occur most, at most `most` of them; ties at the last count stay out together."""
    marked = F.replace(whole(text), F.lit("\n"), F.lit(" \n"))
    raw = docs.select(F.explode(F.split(marked, " ")).alias("w")).filter((F.col("w") != "") & (F.length("w") <= longest - 1))
    counts = raw.groupBy("w").count()
    word = F.when(F.col("w").startswith("\n"), F.substring("w", 2, longest)).otherwise(F.concat(F.lit(SPACE), "w"))
    counts = stored(counts.select(word.alias("word"), "count").filter((F.col("word") != "") & (F.col("count") > 1)), "words")
    # How many words have each count: as many rows as there are different counts.
    ladder = counts.groupBy(F.least("count", F.lit(100_000)).alias("c")).count().orderBy(F.desc("c")).collect()
    taken, floor = 0, 100_001
    for c, n in ladder:
        if taken + n > most:
            break
        taken, floor = taken + n, c
    return counts.filter(F.col("count") >= floor).select("word").distinct()


def lattice(words: DataFrame, pieces: DataFrame, reach: int) -> DataFrame:
    """(word, n, edges): of each word every piece in it, as struct<start, end, score, id>, places from 0."""
    start = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start")
    begun = words.filter("word != ''").select("word", start)
    parts = begun.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(reach), F.length("word") - F.col("start")))).alias("len"))
    parts = parts.select("word", "start", (F.col("start") + F.col("len")).alias("end"), F.substring("word", F.col("start") + 1, F.col("len")).alias("piece"))
    # The piece table is the model's own and doesn't grow with the data.
    edges = parts.join(F.broadcast(pieces), "piece")
    found = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges"))
    return found.select("word", F.length("word").alias("n"), "edges")


def viterbi(edges: Column, n: Column) -> Column:
    """The ids of the path with the highest sum of scores; null if pieces don't reach the end. Ties: the shorter last piece."""
    state = "array<struct<score:double,ids:array<int>>>"
    none = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<int>").alias("ids"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))), F.array_repeat(none, n)).cast(state)

    def step(best: Column, e: Column) -> Column:
        before = F.get(best, e["start"])
        score = before["score"] + e["score"]
        now = F.get(best, e["end"])["score"]
        better = score.isNotNull() & (now.isNull() | (score >= now))
        path = F.struct(score.alias("score"), F.array_append(before["ids"], e["id"]).alias("ids"))
        return F.when(better, F.transform(best, lambda x, i: F.when(i == e["end"], path).otherwise(x))).otherwise(best).cast(state)

    last = F.aggregate(edges, start, step, lambda best: F.get(best, n))
    return F.when(last["score"].isNotNull(), last["ids"])


def merge(edges: Column, n: Column) -> Column:
    """The ids after merging the best-scored neighbours until none is a piece; null if some character has no piece."""
    place = lambda a, b: a * 256 + b
    table = lambda field: F.map_from_entries(F.transform(edges, lambda e: F.struct(place(e["start"], e["end"]), e[field])))
    # The tables travel in the fold's state, so that they are built once a word.
    start = F.struct(F.sequence(F.lit(0), n).alias("at"), table("score").alias("scores"), table("id").alias("ids"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        pairs = F.transform(F.slice(at, 1, F.greatest(F.size(at) - 2, F.lit(0))), lambda a, i: F.struct(F.try_element_at(acc["scores"], place(a, F.get(at, i + 2))).alias("score"), (-i).alias("at")))
        best = F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull()))["at"]
        joined = F.concat(F.slice(at, 1, 1 - best), F.slice(at, 3 - best, F.size(at)))
        return F.struct(F.when(best.isNull(), at).otherwise(joined).alias("at"), acc["scores"].alias("scores"), acc["ids"].alias("ids"))

    def finish(acc: Column) -> Column:
        at = acc["at"]
        return F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, i: F.try_element_at(acc["ids"], place(a, F.get(at, i + 1))))

    out = F.aggregate(F.array_repeat(F.lit(0), n - 1), start, step, finish)
    return F.when(~F.exists(out, lambda x: x.isNull()), out)


def word_ids(words: DataFrame, model: dict, rule: str = "merge") -> DataFrame:
    """(word, ids) of the words that pieces cover."""
    spark = words.sparkSession
    pieces = spark.createDataFrame(model["pieces"], "piece string, id int, score double")
    # Few bytes, but much work: dealt out by hand, in the layout that the grouping needs.
    words = words.repartition(TASKS, "word")
    found = lattice(words, pieces, max((len(p) for p, _, _ in model["pieces"]), default=1))
    fold = {"merge": merge, "viterbi": viterbi}[rule]
    return found.select("word", fold(F.col("edges"), F.col("n")).alias("ids")).filter("ids IS NOT NULL")


class Codec:
    """Ids of whole texts: frequent words by the dictionary from the lattice, the others by the merge rule."""

    def __init__(self, model: dict, known: dict[str, bytes]) -> None:
        self.known, self.memo, self.room = known, {}, MEMO_BYTES
        self.ids = {p: i for p, i, _ in model["pieces"]}
        self.scores = {p: s for p, _, s in model["pieces"]}
        self.first_byte, self.unknown = model["bytes"], model["unknown"]
        self.raw: list[bytes] = [b""] * model["size"]
        for p, i, _ in model["pieces"]:
            self.raw[i] = p.replace(SPACE, " ").encode()
        if self.first_byte is not None:
            for b in range(256):
                self.raw[self.first_byte + b] = bytes([b])
        self.width, self.letters = np.array([len(x) for x in self.raw], np.int64), np.frombuffer(b"".join(self.raw), np.uint8)

    def fold(self, word: str) -> list[int]:
        """The merge rule: the best-scored neighbours join, the leftmost of equals."""
        if len(word) > SHORT:
            return self.fold_long(word)
        score, none = self.scores.get, -math.inf
        parts = list(word)
        rated = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while rated and (best := max(rated)) > none:
            i = rated.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rated[i]
            if i < len(rated):
                rated[i] = score(parts[i] + parts[i + 1], none)
            if i:
                rated[i - 1] = score(parts[i - 1] + parts[i], none)
        return self.numbers(parts)

    def numbers(self, parts: list[str]) -> list[int]:
        """The ids of pieces; of characters without one those of their bytes."""
        out: list[int] = []
        for part in parts:
            if part in self.ids:
                out.append(self.ids[part])
            elif self.first_byte is None:
                out.append(self.unknown)
            else:
                out += [self.first_byte + b for b in part.encode("utf-8", "surrogatepass")]
        return out

    def fold_long(self, word: str) -> list[int]:
        """The merge rule with a heap: n log n."""
        n, scores = len(word), self.scores
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < n and (s := scores.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-s, a, end[a], end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            if end[a] != mid or mid >= n or end[mid] != stop or nxt[a] != mid:
                continue
            end[a], end[mid] = stop, -1
            nxt[a] = nxt[mid]
            if nxt[a] < n:
                prev[nxt[a]] = a
            if prev[a] >= 0:
                offer(prev[a])
            offer(a)
        parts, a = [], 0
        while a < n:
            parts.append(word[a : end[a]])
            a = nxt[a]
        return self.numbers(parts)

    def word(self, word: str) -> bytes:
        """A word's ids, from the dictionary of the lattice or else by the merge rule."""
        got = self.known.get(word) or self.memo.get(word)
        if got is None:
            got = np.array(self.fold(word), "<u4").tobytes()
            if self.room > 0:  # words that are met early are the frequent ones
                self.memo[word] = got
                self.room -= ENTRY + len(word) + len(got)
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        return np.frombuffer(b"".join(map(self.word, _WORDS.findall(SPACE + text.replace(" ", SPACE)))), "<u4")

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, the ids of all of them)."""
        parts = [self._encode(texts.slice(a, SLICE)) for a in range(0, len(texts), SLICE)]
        return np.concatenate([n for n, _ in parts] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in parts] or [np.zeros(0, "<u4")])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `encode_all`; each different word is looked up once."""
        odd = np.array([not (t := x.as_py()) or bool(_RUNS.search(t)) for x in texts], bool)
        usual = texts.filter(pa.array(~odd))
        sizes, ids = np.zeros(0, np.int64), np.zeros(0, "<u4")
        if len(usual):
            heads, which, words = coded(pc.split_pattern(usual, " "))
            raw = [self.word(w) if "\n" not in w else b"".join(map(self.word, _WORDS.findall(w))) for w in (SPACE + x for x in words.to_numpy(zero_copy_only=False).tolist())]
            n, ids = gathered(np.array([len(x) for x in raw], np.int64) // 4, np.frombuffer(b"".join(raw), "<u4"), which)
            sizes = np.add.reduceat(n, heads)
        if not odd.any():
            return sizes, ids
        parts, own = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []), iter([self.encode(t) for t in texts.filter(pa.array(odd)).to_pylist()])
        every = [next(own) if x else next(parts) for x in odd.tolist()]
        return np.array([len(x) for x in every], np.int64), np.concatenate(every)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(np.array([len(ids)]), ids)[0].decode("utf-8", "replace")

    def decode_all(self, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text."""
        n, raw = gathered(self.width, self.letters, ids)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        line = raw.tobytes()
        return [line[a + (line[a : a + 1] == b" " and a < b) : b] for a, b in zip(ends, ends[1:])]


def codec_parts(docs: DataFrame, model_path: str, text: str) -> tuple[dict, dict[str, bytes]]:
    model = read_model(model_path)
    rows = word_ids(frequent(docs, text), model).toArrow()
    return model, {w: np.array(ids, "<u4").tobytes() for w, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())}


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the text's ids (array<int>) in the column `out`."""
    if out in docs.columns:
        raise ValueError(f"the input already has a column {out}")
    model, known = codec_parts(docs, model_path, text)
    shared, token = docs.sparkSession.sparkContext.broadcast((model, known)), f"codec {uuid.uuid4().hex}"
    names = docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ids = kept(token, lambda: Codec(*shared.value)).encode_all(b.column(len(names)))
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], names=[*names, out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return arrow_map(docs.withColumn(free_name(docs, "__t"), whole(text)), run, f"{schema}`{out}` array<int>")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many ids, their checksum and digest, and whether they decode to the text."""
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model, known = codec_parts(docs, public_tokenizers.path("piece_bpe_32k.model"), "text")
    shared, token = spark.sparkContext.broadcast((model, known)), f"codec {uuid.uuid4().hex}"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = kept(token, lambda: Codec(*shared.value))
        rows: list[list] = [[], [], [], []]
        for a in range(0, b.num_rows, SLICE):
            texts, at = b.column(1).slice(a, SLICE), 0
            sizes, ids = codec.encode_all(texts)
            every = memoryview(ids.astype("<u4").tobytes())
            for t, n, back in zip(texts, sizes.tolist(), codec.decode_all(sizes, ids)):
                raw, at = every[4 * at : 4 * (at + n)], at + n
                for c, v in zip(rows, (n, zlib.crc32(raw), hashlib.sha256(raw).hexdigest(), back == t.as_py().encode())):
                    c.append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(rows, types)]], names=["doc_id", "n_tokens", "ids_crc32", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", whole("text").alias("t")), run, f"doc_id {kind}, n_tokens long, ids_crc32 long, ids_sha256 string, round_trip boolean")

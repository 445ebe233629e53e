"""Benchmark decontamination by an embedded random walk and bit sampling.

A document is read in windows as long as the item. Such a window is embedded stretch by stretch: from each
word on (and each character of scripts that leave no space), a CGK walk reads the byte at its place, writes it, and
moves on by a random bit that depends on the step and the byte, so that strings at a small edit distance write
strings at a small Hamming distance. To begin anew at each word keeps an edit from spoiling what follows.
A fixed set of written places is sampled for a key, in REPEATS walks with random bits of their own. Every
stretch of every item is indexed and every stretch of every document is looked up; a shared key proposes the
item-sized window that would put the two stretches in the same place. How far a walk goes and how many places
it samples depends on the item's length alone (RUNGS), for a recall of TARGET when a fifth of the characters
are edited at random. Nothing depends on the other items.

Two steps verify a window. It must hold enough of the item's GRAM-grams: a smaller share than nearly every window has
whose item kept SIMILARITY of its characters (`share_needed`). Then the least edit distance of the whole item, in
characters, to any part of it is computed exactly (bit-parallel); it counts as leaked from SIMILARITY on.

Items of under EXACT bytes, of which no edit can be told from chance, are found where they stand word for word.
Items are a stated query set: they go out in blocks of at most BLOCK_CHARS characters, one block at a time, so that
neither the driver nor a broadcast holds more, whatever their number. Texts compare lower-cased, with white space
as single spaces.

Edge cases: null, empty or blank texts and items never match; repeated items report each id; repeated documents
report each row; empty tables give empty results; other columns pass through `without_leaks` unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import kept, load, small_batches, stored, union_all, whole

SIMILARITY = 0.8
TARGET = 0.97
REPEATS = 4
BLOCK_CHARS = 2_000_000
#: Bytes under which an item is found word for word only.
EXACT = 24
#: (bytes of an item from which a rung serves, steps of its walk, how many of the steps since the rung before are
#: sampled). Chosen by trial for TARGET; tests/llm/recall.py measures what they reach.
RUNGS = ((0, 12, 10), (60, 20, 4), (114, 24, 2), (200, 28, 2))
GRAM, GRAM_BITS = 5, 13
#: Places of a window that lie this near are tried once.
NEAR = 16
SLICE = 1 << 15
GROUP = 1 << 20
LOOKUPS = 1 << 22
#: Stands between lines that are walked together: longer than a walk reads.
BETWEEN = b" " + b"\x00" * (RUNGS[-1][1] + 8) + b" "


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def word_starts(line: bytes) -> np.ndarray:
    """Where stretches of a normal line start: at each word and each character of three bytes or more."""
    if not line:
        return np.zeros(0, np.int64)
    b = np.frombuffer(line, np.uint8)
    begins = b >= 0xE2
    begins[1:] |= b[:-1] == 32
    begins[0] = True
    return np.flatnonzero(begins)


_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def walks() -> list[tuple[np.ndarray, set[int]]]:
    """Of each repetition: the move of every step and byte, the sampled places."""
    rng, out = np.random.default_rng(7), []
    for _ in range(REPEATS):
        moves, sampled, begun = rng.integers(0, 2, (RUNGS[-1][1], 256)).astype(np.int64), set(), 0
        for _, end, n in RUNGS:
            sampled |= set((begun + rng.choice(end - begun, n, replace=False)).tolist())
            begun = end
        out.append((moves, sampled))
    return out


WALKS = walks()


def rung_of(size: int) -> int:
    """The rung that serves an item of `size` bytes."""
    return max(i for i, r in enumerate(RUNGS) if r[0] <= size)


def keys(line: bytes, starts: np.ndarray, walk: tuple[np.ndarray, set[int]], wanted: set[int]) -> dict[int, np.ndarray]:
    """Of each wanted rung, the sampled key of the walk from each start on; walks past the end read zeros."""
    moves, sampled = walk
    ends = {RUNGS[i][1] - 1: i for i in wanted}
    padded = np.concatenate((np.frombuffer(line, np.uint8), np.zeros(RUNGS[-1][1] + 1, np.uint8)))
    out = {i: np.empty(len(starts), np.uint64) for i in wanted}
    for a in range(0, len(starts), SLICE):
        at = starts[a : a + SLICE].astype(np.int64)
        key, x, step = np.zeros(len(at), np.uint64), np.empty(len(at), np.uint8), np.empty(len(at), np.int64)
        for j in range(max(ends, default=-1) + 1):
            padded.take(at, out=x, mode="clip")
            if j in sampled:
                key *= _FACTOR
                key += x
            if j in ends:
                got = key ^ key >> np.uint64(31)
                got *= _FACTOR
                out[ends[j]][a : a + len(key)] = got
            moves[j].take(x, out=step, mode="clip")
            at += step
    return out


def grams(line: bytes) -> np.ndarray:
    """A number of GRAM_BITS bits of every GRAM bytes in a row."""
    c = np.frombuffer(line, np.uint8).astype(np.uint32)
    n = max(0, len(c) - GRAM + 1)
    h = np.zeros(n, np.uint32)
    for j in range(GRAM):
        h = (h ^ c[j : j + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


def share_needed(size: int, similarity: float) -> float:
    """What share of an item's different grams a window must hold, if the item has `size` bytes.

    Of random edits, similarity ** GRAM of the grams survive, and some more match by chance; a margin that shrinks with the
    root of the size leaves out at most one in a hundred of the windows that hold the item at `similarity` (own trial
    with replaced, deleted and mixed characters, items of 30 to 390 bytes).
    """
    return similarity**GRAM + 0.08 - 1.74 / size**0.5


class Items:
    """A block of items, ready to be searched for: the keys of all their stretches, sorted."""

    def __init__(self, rows: list[tuple], similarity: float = SIMILARITY) -> None:
        self.ids, self.lines, self.budget, self.masks, self.size, self.need = [], [], [], [], [], []
        parts: dict[tuple[int, int], list[np.ndarray]] = {}
        short: dict[str, list] = {}
        have: list[np.ndarray] = []
        for ident, line in ((i, normal(t or "")) for i, t in rows):
            chars = line.decode("utf-8", "surrogatepass")
            if len(line) < EXACT:
                if chars:
                    short.setdefault(chars, []).append(ident)
                continue
            k = len(self.ids)
            self.ids.append(ident)
            self.lines.append(chars)
            self.budget.append(int((1 - similarity) * len(chars) + 1e-9))
            self.size.append(len(line))
            own = np.unique(grams(line))
            self.need.append(max(1, int(len(own) * share_needed(len(line), similarity))))
            masks: dict[str, int] = {}
            for i, c in enumerate(chars):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
            have.append(np.zeros(1 << GRAM_BITS, bool))
            have[-1][own] = True
            rung, starts = rung_of(len(line)), word_starts(line)
            starts = starts[(starts + RUNGS[rung][1] // 2 <= len(line)) | (starts == 0)]
            for r, walk in enumerate(WALKS):
                own = keys(line, starts, walk, {rung})[rung]
                parts.setdefault((r, rung), []).append(np.stack([own, np.full(len(own), k, np.uint64), starts.astype(np.uint64)]))
        self.rungs = {rung for _, rung in parts}
        self.tables = {}
        for which, part in parts.items():
            t = np.concatenate(part, axis=1)
            t = t[:, np.argsort(t[0], kind="stable")]
            seen = np.zeros(1 << 20, bool)
            seen[(t[0] >> np.uint64(44)).astype(np.int64)] = True
            self.tables[which] = (seen, t[0], t[1].astype(np.int64), t[2].astype(np.int64))
        self.have = np.concatenate(have) if have else np.zeros(0, bool)
        # A window reaches beyond the item by its budget, in bytes, on both sides, and by NEAR.
        self.slack = np.array([2 * b + 8 for b in self.budget], np.int64)
        self.span = np.array([-(-(n + 2 * b + 2 * NEAR) // 32) * 32 for n, b in zip(self.size, self.budget)], np.int64)
        self.short = None
        if short:
            import ahocorasick

            self.short = ahocorasick.Automaton()
            for chars, idents in short.items():
                self.short.add_word(f" {chars} ", (chars, idents))
            self.short.make_automaton()

    def search(self, text: str) -> list[tuple]:
        return self.search_all([text])[0]

    def search_all(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text, (id, distance, similarity, start, end) of the best place of every item that leaked; characters of the normal line."""
        lines = [normal(t) for t in texts]
        out: list[list[tuple]] = []
        a = 0
        while a < len(lines):
            b, size = a, 0
            while b < len(lines) and (b == a or size + len(lines[b]) < GROUP):
                size += len(lines[b])
                b += 1
            out += self._search(lines[a:b]) if self.ids else [[] for _ in lines[a:b]]
            a = b
        if self.short is not None:
            for line, found in zip(lines, out):
                self.word_for_word(line, found)
        return out

    def word_for_word(self, line: bytes, found: list[tuple]) -> None:
        """Adds the short items' first places."""
        met: dict[str, tuple[list, int]] = {}
        for end, (chars, idents) in self.short.iter(f" {line.decode('utf-8', 'surrogatepass')} "):
            met.setdefault(chars, (idents, end - 1))
        for chars, (idents, end) in met.items():
            found += [(i, 0, 1.0, end - len(chars), end) for i in idents]

    def windows(self, joined: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, place) of every window that a shared key proposes, once for places NEAR one another."""
        starts, found = word_starts(joined), [np.zeros(0, np.int64)]
        for r, walk in enumerate(WALKS if len(starts) else []):
            for rung, got in keys(joined, starts, walk, self.rungs).items():
                seen, known, item, word = self.tables[r, rung]
                at = np.flatnonzero(seen[(got >> np.uint64(44)).astype(np.int64)])
                lo, n = np.searchsorted(known, got[at], "left"), np.searchsorted(known, got[at], "right")
                n -= lo
                q = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                p = np.repeat(starts[at], n)
                doc = np.searchsorted(first, p, "right") - 1
                # The window starts where the item would, counted in bytes; items are shorter than 2 ** 31.
                place = np.maximum(p - first[doc] - word[q], -NEAR) + NEAR
                found.append(np.unique((doc * len(self.ids) + item[q] << 32) + place // NEAR))
        every = np.unique(np.concatenate(found))
        pair = every >> 32
        return pair // max(1, len(self.ids)), pair % max(1, len(self.ids)), ((every & 0xFFFFFFFF) - 1) * NEAR

    def alike(self, codes: np.ndarray, begin: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the window that begins at `begin`, of the item's span, holds enough of its grams."""
        out = np.zeros(len(item), bool)
        span, need = self.span[item], np.array(self.need)[item]
        for wide in np.unique(span).tolist():
            every, reach = np.flatnonzero(span == wide), np.arange(wide)
            step = max(1, LOOKUPS // wide)
            for a in range(0, len(every), step):
                some = every[a : a + step]
                hits = self.have[codes[begin[some][:, None] + reach] + (item[some] << GRAM_BITS)[:, None]]
                out[some] = np.count_nonzero(hits, axis=1) >= need[some]
        return out

    def _search(self, lines: list[bytes]) -> list[list[tuple]]:
        """The lines are walked as one, with a word between them that no item has."""
        out: list[list[tuple]] = [[] for _ in lines]
        joined = BETWEEN.join(lines)
        first = np.cumsum([0] + [len(x) + len(BETWEEN) for x in lines[:-1]])
        doc, item, place = self.windows(joined, first)
        if not len(doc):
            return out
        codes = np.concatenate((grams(joined), np.zeros(int(self.span.max()) + GRAM, np.int32)))
        begin = np.maximum(first[doc] + place - np.array(self.budget)[item], 0)
        good = self.alike(codes, np.minimum(begin, len(joined)), item)
        doc, item, place = doc[good], item[good], place[good]
        order = np.lexsort((place, item, doc))
        doc, item, place = doc[order], item[order], place[order]
        pair = doc * len(self.ids) + item
        begun = np.flatnonzero(np.diff(pair, prepend=-1)).tolist()
        for a, b in zip(begun, [*begun[1:], len(pair)]):
            d, k = int(doc[a]), int(item[a])
            at, line = int(first[d]), lines[d]
            held = [(x, y) for x, y in self.stretches(k, line, place[a:b].tolist()) if self.holds(k, codes[at + x : max(at + x, at + y - GRAM + 1)])]
            found = [x for begin, end in held if (x := self.verify(k, line, begin, end))]
            if found:
                out[d].append((self.ids[k], *min(found, key=lambda x: x[0])))
        return out

    def holds(self, k: int, codes: np.ndarray) -> bool:
        """Whether a stretch, by its grams, has enough different ones of the item."""
        own = codes[self.have[codes + (k << GRAM_BITS)]]
        return len(own) >= self.need[k] and np.count_nonzero(np.bincount(own)) >= self.need[k]

    def stretches(self, k: int, line: bytes, places: list[int]) -> list[tuple[int, int]]:
        """Where each stretch of the line begins and ends, in bytes; places that lie near one another are one."""
        slack, wide = int(self.slack[k]), self.size[k]
        found: list[list[int]] = []
        for place in places:
            if found and place - found[-1][1] <= slack:
                found[-1][1] = place
            else:
                found.append([place, place])
        out = []
        for first, last in found:
            a, b = max(0, first - slack), min(len(line), last + wide + slack + NEAR)
            while a > 0 and line[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(line) and line[b] & 0xC0 == 0x80:
                b += 1
            if a < b:
                out.append((a, b))
        return out

    def verify(self, k: int, line: bytes, a: int, b: int) -> tuple | None:
        """The best place of the item in the line from byte `a` to `b`."""
        item = self.lines[k]
        d, end = distance_within(self.masks[k], len(item), line[a:b].decode("utf-8", "surrogatepass"))
        if d > self.budget[k]:
            return None
        before = len(line[:a].decode("utf-8", "surrogatepass"))
        return d, round(1 - d / len(item), 6), max(0, before + end - len(item)), before + end


def distance_within(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(the least edit distance of the pattern to any part of `text`, where that part ends), bit-parallel."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i
    return best, end


def item_blocks(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple], bool]]:
    """The items in blocks of about `limit` characters each, one at a time, and whether it is the only one."""
    rows = benchmark.select(F.col(key).alias("k"), whole(text).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(total // limit) + 1
    block = F.pmod(F.xxhash64("k", "t"), F.lit(n))
    for i in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.filter(block == i)).collect()], n == 1


LEAK = "array<struct<item:{0},distance:int,similarity:double,start:long,end:long>>"


def _searched(docs: DataFrame, block: list[tuple], text: str, ident: DataType, keep_clean: bool, similarity: float) -> DataFrame:
    """`docs` rows that share an item, with the leaks; or, with keep_clean, the rows that don't, unchanged."""
    from pyspark.sql.pandas.types import to_arrow_type

    token = f"items {uuid.uuid4().hex}"
    small_batches(docs.sparkSession)
    fields = [("item", to_arrow_type(ident)), ("distance", pa.int32()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]

    def run(batches):
        items = kept(token, lambda: Items(block, similarity))
        for b in batches:
            found = items.search_all([t or "" for t in b.column(text).to_pylist()])
            mask = np.array([bool(f) != keep_clean for f in found], bool)
            if not mask.any():
                continue
            out = b.filter(pa.array(mask))
            if not keep_clean:
                leaks = [[dict(zip([n for n, _ in fields], x)) for x in f] for f, m in zip(found, mask) if m]
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(leaks, pa.list_(pa.struct(fields)))], names=[*out.schema.names, "__leaks"])
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema if keep_clean else f"{schema}, __leaks {LEAK.format(ident.simpleString())}")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, item, distance, similarity, start, end): one row for each item that a document holds."""
    names = [key, item, "distance", "similarity", "start", "end"]
    if len(set(names)) < len(names):
        raise ValueError(f"names of the result clash: {names}")
    kind, parts = benchmark.schema[item].dataType, []
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    for block, only in item_blocks(benchmark, item, item_text):
        found = _searched(rows, block, "__text", kind, False, similarity).select("__key", F.explode("__leaks").alias("x"))
        parts.append(found if only else stored(found, "leaks"))
    return union_all(parts).select(F.col("__key").alias(key), F.col("x.item").alias(item), "x.distance", "x.similarity", "x.start", "x.end")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the rows that hold an item; no shuffle, the other rows pass unchanged."""
    kind = benchmark.schema[item].dataType
    for block, only in item_blocks(benchmark, item, item_text):
        docs = _searched(docs, block, text, kind, True, similarity)
        docs = docs if only else stored(docs, "without-leaks")
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"))

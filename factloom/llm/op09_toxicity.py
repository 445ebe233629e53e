"""Toxicity by compression distance.

Two zstandard dictionaries are trained. Both hold what the trainer makes of ordinary texts without telling words; each also holds what
it makes of its own class's words: those that begin as words of the other class's texts hardly ever do. A text is
cut into overlapping windows; each is compressed with either dictionary, and the bytes that the toxic one saves
are compared with several thresholds. How many windows pass each of them, and how many windows there are, go into a
logistic curve, fitted on the labelled rows: it calibrates the score, and 0.5 is the line.

The fit reads a bounded sample of the labelled rows: of each class at most FIT rows, those with the least hash of their
id, as whole texts of FIT_CHARS characters together. A beginning counts once for each pair of neighbours it was met
between, so copies of a text don't make its words look typical. Only the text is an input of the score.

Edge cases: null or empty texts are one empty window, with a score from the curve; with no labelled row of a
class nothing can be told apart: the score is the other class's share everywhere and `keep_ordinary` keeps all;
repeated rows score alike, and of labelled rows that share an id the least text is read; empty tables
give empty results; other columns pass unchanged. Every window of a text counts, whatever its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from heapq import nlargest
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, free_name, load, whole

FIT, FIT_CHARS = 1500, 20_000_000
FOLDS = 5
WINDOW, STRIDE = 48, 32
#: Bytes of the trained dictionaries, and the trainer's length of a match and of a segment.
BACKGROUND, OWN = (16384, 8, 64), (2048, 6, 16)
MIN_CONTEXTS, MIN_ODDS, SHARE = 4, 1.5, 0.15
CANDIDATES = 4000
#: The fit's words are numbered and counted by so many at a time.
SLICE = 1 << 16
LEVEL = 9
#: Every window begins as both dictionaries do. Without it zstandard would store a window as it is if little is saved, and
#: hide the difference.
LEAD = b"\x01the beginning of both dictionaries\x02"
#: The compressor never looks up the last bytes of a dictionary: these are none of a text's.
TAIL = b"\x01\x02\x03\x04\x05\x06\x07\x08" * 2
#: Savings of windows are counted from -FLOOR to TOP bytes, and compared with THRESHOLDS.
FLOOR, TOP = 3, 12
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
_WORD = re.compile(r"\w+")


def _odds(a: float, b: float, total: dict[int, float], k: int) -> float:
    return math.log((a + 0.5) / total[k]) - math.log((b + 0.5) / total[1 - k])


def numbered(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The different words of all texts in order, and all words of the texts as numbers of these, with 0 before and after each text."""
    each = (x for t in [*texts, None] for x in chain([""], (m.group() for m in _WORD.finditer(t.lower())) if t else ()))
    parts = []
    while part := list(islice(each, SLICE)):
        parts.append(pa.array([x.encode("utf-8", "surrogatepass") for x in part], pa.binary()).dictionary_encode())
    coded = pa.chunked_array(parts).unify_dictionaries()
    names = coded.chunk(0).dictionary
    order = pc.array_sort_indices(names)
    rank = np.empty(len(names), np.int32)
    rank[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
    return names.take(order), np.concatenate([rank[c.indices.to_numpy()] for c in coded.chunks])


def beginnings(names: pa.Array) -> Iterator[tuple[str, int, int]]:
    """Every word and every beginning of words, of 3 to 8 letters, as they stand after a space, and the range of the words in `names` that begin so."""
    begun: list[tuple[str, int]] = []
    for s in range(1, len(names), SLICE):
        for i, raw in enumerate(names.slice(s, SLICE).to_pylist(), s):
            word = raw.decode("utf-8", "surrogatepass")
            while begun and not word.startswith(begun[-1][0]):
                x, first = begun.pop()
                yield f" {x}", first, i
            begun += [(word[:n], i) for n in range(3 + len(begun), min(8, len(word)) + 1)]
            yield f" {word} ", i, i + 1
    for x, first in begun:
        yield f" {x}", first, len(names)


def occurrences(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of `n` words occurs, at most four times a text, and between how many different pairs of neighbours; both summed up from the first word on."""
    upto = np.bincount(words, minlength=n).cumsum()
    often, places = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    first, ends = 1, np.flatnonzero(words == 0)
    while first < n:
        # Words of SLICE occurrences together at a time, or a single one.
        last = max(first + 1, int(np.searchsorted(upto, upto[first - 1] + SLICE, "right")))
        at = np.flatnonzero((words >= first) & (words < last))
        at = at[np.argsort(words[at], kind="stable")]
        w, text = words[at], np.searchsorted(ends, at)
        more = np.zeros(len(at), bool)
        more[4:] = (w[4:] == w[:-4]) & (text[4:] == text[:-4])
        often[first + 1 : last + 1] = np.bincount(w[~more] - first, minlength=last - first)
        near = words[at - 1].astype(np.int64) * n + words[at + 1]
        o = np.lexsort((near, w))
        w, near = w[o], near[o]
        new = np.ones(len(at), bool)
        new[1:] = (w[1:] != w[:-1]) | (near[1:] != near[:-1])
        places[first + 1 : last + 1] = np.bincount(w[new] - first, minlength=last - first)
        first = last
    return often.cumsum(), places.cumsum()


def contrasts(texts: dict[int, list[str]]) -> dict[int, list[tuple[float, str]]]:
    """Of each class the words and beginnings of words that tell it from the other, best first."""
    names, words = numbered(texts[0] + texts[1])
    pa.default_memory_pool().release_unused()
    cut = np.flatnonzero(words == 0)[len(texts[0])]
    of = {0: words[: cut + 1], 1: words[cut:]}
    total = {k: float(np.count_nonzero(of[k])) + 1.0 for k in of}
    often, places = zip(*(occurrences(of[k], len(names)) for k in of))

    def rated(k: int) -> Iterator[tuple[float, str, int, int]]:
        for g, i, j in beginnings(names):
            if (n := int(often[k][j] - often[k][i])) >= MIN_CONTEXTS:
                yield _odds(n, int(often[1 - k][j] - often[1 - k][i]), total, k) * math.sqrt(n), g, i, j

    asked = {g: (i, j) for k in of for _, g, i, j in nlargest(CANDIDATES, rated(k))}
    found: dict[int, list] = {0: [], 1: []}
    for g, (i, j) in asked.items():
        near = [int(places[k][j] - places[k][i]) for k in of]
        for k in of:
            odds = _odds(near[k], near[1 - k], total, k)
            if near[k] >= MIN_CONTEXTS and odds > MIN_ODDS:
                found[k].append((odds * math.sqrt(near[k]), len(g), g))
    best = max((x[0] for rows in found.values() for x in rows), default=0)
    out: dict[int, list[tuple[float, str]]] = {0: [], 1: []}
    for k, rows in found.items():
        for score, _, g in sorted(rows, reverse=True):
            if score >= SHARE * best and not any(g.startswith(x) or x.startswith(g) for _, x in out[k]):
                out[k].append((score, g))
    return out


def flat(text: str) -> str:
    """The whole text, lower-cased, with white space as single spaces."""
    return f" {' '.join(text.lower().split())} "


def trained(samples: list[bytes], size: int, match: int, segment: int) -> bytes:
    """What zstandard's trainer makes of the samples; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, d=match, k=segment).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(texts: dict[int, list[str]]) -> dict[int, bytes]:
    """The content of both dictionaries: the background, of ordinary texts without telling words, then what is the class's own (nearest)."""
    begins = {k: tuple(g for _, g in rows) for k, rows in contrasts(texts).items()}
    telling = re.compile("|".join(re.escape(g.strip()) for gs in begins.values() for g in gs) or r"(?!)")
    plain = (" ".join(w for w in t.lower().split() if not telling.search(w)) for t in texts[0])
    background = trained([f" {t} ".encode("utf-8", "surrogatepass") for t in plain], *BACKGROUND)
    own: dict[int, bytes] = {}
    for k, gs in begins.items():
        samples = ["".join(f" {w}" for m in _WORD.finditer(t.lower()) if f" {(w := m.group())} ".startswith(gs)) for t in texts[k]] if gs else []
        own[k] = trained([f"{x} ".encode("utf-8", "surrogatepass") for x in samples if x], *OWN) if any(samples) else b""
    # Bytes that no text has fill the shorter one up, so that the background lies equally far in both.
    wide = max(map(len, own.values()))
    return {k: LEAD + background + b"\xff" * (wide - len(x)) + x + TAIL for k, x in own.items()}


def windows(text: str) -> Iterator[bytes]:
    raw = flat(text).encode("utf-8", "surrogatepass")
    return (raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STRIDE)), STRIDE))


class Scorer:
    def __init__(self, contents: dict[int, bytes], weights: list[float] | None = None) -> None:
        import zstandard

        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.press = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain).compress for k, d in contents.items()}
        self.weights = weights

    def evidence(self, text: str) -> list[float]:
        """Logs of how many windows there are, how many the toxic dictionary makes shorter by each threshold, how many longer by FLOOR."""
        a, b = self.press[0], self.press[1]
        saved = np.fromiter((len(a(LEAD + w)) - len(b(LEAD + w)) for w in windows(text)), np.int64)
        counts = np.bincount(np.clip(saved, -FLOOR, TOP) + FLOOR, minlength=FLOOR + TOP + 1)
        over = counts[::-1].cumsum()[::-1]
        return [math.log1p(x) for x in (len(saved), *(over[FLOOR + t] for t in THRESHOLDS), counts[0])]

    def score(self, text: str) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep @ w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), grad)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], share_toxic: float | None = None) -> dict:
    """A model of (text, label) rows: {contents, weights}, or {prior} if a class has no row.

    share_toxic is the share of label 1 among all labelled rows, if `rows` hold another.
    """
    texts = {k: [t or "" for t, y in rows if y == k] for k in (0, 1)}
    if not texts[0] or not texts[1]:
        return {"prior": float(bool(texts[1])) if rows else 0.0}
    contents = dictionaries(texts)
    plain = Scorer(contents)
    x = np.array([plain.evidence(t) for k in (0, 1) for t in texts[k]])
    weights = logistic(x, np.repeat([0.0, 1.0], [len(texts[0]), len(texts[1])]))
    if share_toxic is not None and 0 < share_toxic < 1:
        weights[0] += math.log(share_toxic / (1 - share_toxic)) - math.log(len(texts[1]) / len(texts[0]))
    return {"contents": contents, "weights": weights.tolist()}


def held_out(key: Column | str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model of the labelled rows outside the held-out fold; at most FIT rows of each class reach the driver."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").filter(~held_out("k")).distinct()
    picked = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(FIT) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))
    # A key that very many rows share adds one row to the fit.
    found = docs.select(F.col(key).alias("k"), whole(text).alias("t")).join(few, "k").groupBy("y", "k").agg(F.min("t").alias("t"))
    size = F.sum(F.length("t")).over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k"))
    got = sorted(found.withColumn("n", size).filter(F.col("n") <= FIT_CHARS).select("t", "y", "k").collect(), key=lambda r: (r["y"], r["k"]))
    return fit([(r["t"], r["y"]) for r in got], rows.agg(F.avg("y")).first()[0])


def scored(docs: DataFrame, model: dict, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with the score of the whole text, from 0 to 1, in the column `out`."""
    if out in docs.columns:
        raise ValueError(f"the input already has a column {out}")
    if "prior" in model:
        return docs.withColumn(out, F.lit(model["prior"]))
    names, holder = docs.columns, []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Scorer(model["contents"], model["weights"]))
        scores = pa.array([holder[0].score(t) for t in b.column(len(names)).to_pylist()], pa.float64())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], scores], names=[*names, out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return arrow_map(docs.withColumn(free_name(docs, "__t"), whole(text)), run, f"{schema}`{out}` double")


def keep_ordinary(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows whose text scores 0.5 or more; all of them if the labels lack a class."""
    model = train(docs, labels, key, text)
    if "prior" in model:
        return docs
    score = free_name(docs, "__toxicity")
    return scored(docs, model, text, score).filter(F.col(score) < 0.5).drop(score)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether its fold is held out, its score, and the label that the score says."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # The text goes through the scorer and no further.
    rated = scored(docs, train(docs, load(spark, sf_dir, "labels")), "text", "score").drop("text")
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

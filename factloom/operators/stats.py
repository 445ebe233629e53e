"""Paired statistics of text sizes: ratios, a least-squares index, panels and triangles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("lines", "bytes")


def median_samples(measured: DataFrame) -> DataFrame:
    """(language, task, lines, bytes): medians of either metric by itself, rounded down."""
    return measured.groupBy("language", "task").agg(*[F.floor(F.median(m)).cast("long").alias(m) for m in METRICS])


def summed_samples(measured: DataFrame) -> DataFrame:
    """(language, task, lines, bytes): sums over the files of a task."""
    return measured.groupBy("language", "task").agg(*[F.sum(m).cast("long").alias(m) for m in METRICS])


def floor_units(samples: DataFrame, units: int = 50) -> DataFrame:
    """Samples of the languages that have `units` tasks or more."""
    return samples.join(samples.groupBy("language").agg(F.count("*").alias("n")).filter(F.col("n") >= units).select("language"), "language", "left_semi")


def pairs(samples: DataFrame, shared: int = 25) -> DataFrame:
    """(left, right, lines, bytes, tasks): geometric means of ratios over the tasks both have."""
    full = samples.filter((F.col("lines") > 0) & (F.col("bytes") > 0))
    a, b = full.alias("a"), full.alias("b")
    both = a.join(b, (F.col("a.task") == F.col("b.task")) & (F.col("a.language") < F.col("b.language")))
    ratio = lambda m: F.exp(F.avg(F.log(F.col(f"a.{m}") / F.col(f"b.{m}")))).alias(m)
    out = both.groupBy(F.col("a.language").alias("left"), F.col("b.language").alias("right")).agg(*map(ratio, METRICS), F.count("*").alias("tasks"))
    return out.filter(F.col("tasks") >= shared)


def both_ways(pairs_: DataFrame) -> DataFrame:
    """Each pair and its inverse."""
    back = pairs_.select(F.col("right").alias("left"), F.col("left").alias("right"), *[(1 / F.col(m)).alias(m) for m in METRICS], "tasks")
    return pairs_.select("left", "right", *METRICS, "tasks").unionByName(back)


def solve_index(rows: list[tuple[str, str, float, float]], baseline: str) -> dict[str, float]:
    """Of (left, right, ratio, weight), the index by weighted least squares in logs; the baseline is 1."""
    names = sorted({x for r in rows for x in r[:2]} | {baseline})
    at = {x: i for i, x in enumerate(names)}
    a, y = np.zeros((len(names), len(names))), np.zeros(len(names))
    for left, right, ratio, weight in rows:
        i, j, v = at[left], at[right], weight * np.log(ratio)
        a[i, i] += weight
        a[j, j] += weight
        a[i, j] -= weight
        a[j, i] -= weight
        y[i] += v
        y[j] -= v
    k = at[baseline]
    a[k], a[k, k], y[k] = 0.0, 1.0, 0.0
    return dict(zip(names, np.exp(np.linalg.lstsq(a, y, rcond=None)[0]).tolist()))


def fit(pairs_: DataFrame, baseline: str) -> DataFrame:
    """(language, lines, bytes): the index. Pairs are at most the square of the number of languages."""
    rows = pairs_.select("left", "right", "lines", "bytes", "tasks").collect()
    found = {m: solve_index([(r["left"], r["right"], r[m], float(r["tasks"])) for r in rows], baseline) for m in METRICS}
    return pairs_.sparkSession.createDataFrame([(k, found["lines"][k], found["bytes"][k]) for k in found["lines"]], "language string, lines double, bytes double")


def deviation(pairs_: DataFrame, index: DataFrame) -> DataFrame:
    """(language, deviation): the largest relative error of the index's ratios, in bytes, over the language's pairs."""
    left, right = index.select(F.col("language").alias("left"), F.col("bytes").alias("l")), index.select(F.col("language").alias("right"), F.col("bytes").alias("r"))
    off = F.abs(F.exp(F.log("bytes") - F.log(F.col("l") / F.col("r"))) - 1)
    rated = pairs_.join(F.broadcast(left), "left").join(F.broadcast(right), "right").select(F.explode(F.array("left", "right")).alias("language"), off.alias("off"))
    return rated.groupBy("language").agg(F.max("off").alias("deviation"))


def core(samples: DataFrame, baseline: str) -> DataFrame:
    """(language): those with a third of all tasks, rounded up, and the baseline."""
    units = samples.agg(F.count_distinct("task").alias("units"))
    n = samples.groupBy("language").agg(F.count_distinct("task").alias("n"))
    return n.join(F.broadcast(units), F.col("n") >= F.ceil(F.col("units") / 3), "left").filter(F.col("units").isNotNull() | (F.col("language") == baseline)).select("language")


def balanced_panel(samples: DataFrame, languages: DataFrame) -> DataFrame:
    """(task): the tasks that each of the languages has."""
    n = languages.agg(F.count_distinct("language").alias("n"))
    have = samples.join(languages.distinct(), "language", "left_semi").groupBy("task").agg(F.count_distinct("language").alias("have"))
    return have.join(F.broadcast(n), F.col("have") == F.col("n")).select("task")


def balanced_index(samples: DataFrame, languages: DataFrame, baseline: str) -> DataFrame:
    """(language, lines, bytes): geometric means over the panel, relative to the baseline."""
    panel = balanced_panel(samples, languages)
    own = samples.join(languages.distinct(), "language", "left_semi").join(panel, "task", "left_semi")
    mean = own.groupBy("language").agg(*[F.avg(F.log(m)).alias(m) for m in METRICS])
    base = mean.filter(F.col("language") == baseline).select(*[F.col(m).alias(f"base_{m}") for m in METRICS])
    return mean.crossJoin(F.broadcast(base)).select("language", *[F.exp(F.col(m) - F.col(f"base_{m}")).alias(m) for m in METRICS])


def triangles(pairs_: DataFrame, metric: str = "bytes", top: int | None = 10) -> DataFrame:
    """(a, b, c, composed, direct, disagreement): three measured pairs against each other, the worst first."""
    p = pairs_.select("left", "right", F.col(metric).alias("ratio"))
    ab, bc, ac = (p.select(F.col("left").alias(x), F.col("right").alias(y), F.col("ratio").alias(x + y)) for x, y in ("ab", "bc", "ac"))
    found = ab.join(bc, "b").join(ac, ["a", "c"])
    out = found.select("a", "b", "c", (F.col("ab") * F.col("bc")).alias("composed"), F.col("ac").alias("direct"))
    out = out.withColumn("disagreement", F.abs(F.log(F.col("composed") / F.col("direct"))))
    return out.orderBy(F.desc(F.round("disagreement", 9)), "a", "b", "c").limit(top) if top else out


def matrix(pairs_: DataFrame, metric: str = "bytes", languages: list[str] | None = None) -> DataFrame:
    """One row per language, one column per language: the row's size relative to the column's."""
    every = both_ways(pairs_).select("left", "right", F.col(metric).alias("ratio"))
    own = every.select("left").distinct().select("left", F.col("left").alias("right"), F.lit(1.0).alias("ratio"))
    grid = every.unionByName(own).groupBy(F.col("left").alias("language"))
    return (grid.pivot("right", languages) if languages else grid.pivot("right")).agg(F.first("ratio"))


def ratio_lookup(pairs_: DataFrame, asked: DataFrame, metric: str = "bytes") -> DataFrame:
    """`asked` (left, right) with the ratio in either direction; null for a language with itself or unmeasured."""
    p = pairs_.select(F.col("left").alias("l"), F.col("right").alias("r"), F.col(metric).alias("v"))
    on = (F.least("left", "right") == F.col("l")) & (F.greatest("left", "right") == F.col("r")) & (F.col("left") != F.col("right"))
    out = asked.join(p, on, "left")
    return out.select("left", "right", F.when(F.col("left") == F.col("l"), F.col("v")).otherwise(1 / F.col("v")).alias("ratio"))

"""Corpora of one task solved in many languages, by the layout of their files; and what was published of one of them.

Files come as rows (path, text); sizes are measured without comments. The result is samples (language, task, lines, bytes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions
from ..functions import text as T
from . import stats
from .classify import basename, extension

# Language, folder of a task, extension.
ROSETTA = (
    ("c", "C", "c"), ("c-sharp", "C-sharp", "cs"), ("cpp", "C++", "cpp"), ("go", "Go", "go"), ("java", "Java", "java"), ("javascript", "JavaScript", "js"), ("kotlin", "Kotlin", "kts"), ("make", "Make", "make"), ("php", "PHP", "php"),
    ("python", "Python", "py"), ("ruby", "Ruby", "rb"), ("rust", "Rust", "rs"), ("scala", "Scala", "scala"), ("shell", "UNIX-Shell", "sh"), ("sql", "SQL", "sql"), ("swift", "Swift", "swift"), ("typescript", "TypeScript", "ts"), ("zig", "Zig", "zig"),
)
# Language, track.
TRACKS = (
    ("c", "c"), ("c-sharp", "csharp"), ("cpp", "cpp"), ("go", "go"), ("java", "java"), ("javascript", "javascript"), ("kotlin", "kotlin"), ("php", "php"), ("python", "python"), ("ruby", "ruby"), ("rust", "rust"), ("scala", "scala"),
    ("shell", "bash"), ("swift", "swift"), ("typescript", "typescript"), ("zig", "zig"),
)
# Language, folder of the implementation, extensions.
IMPLEMENTATIONS = (
    ("c", "c", ("c", "h")), ("c-sharp", "cs", ("cs",)), ("cpp", "cpp", ("cpp", "h", "hpp")), ("go", "go", ("go",)), ("java", "java", ("java",)), ("javascript", "js", ("js",)), ("kotlin", "kotlin", ("kt",)), ("php", "php", ("php",)),
    ("python", "python3", ("py",)), ("ruby", "ruby", ("rb",)), ("rust", "rust", ("rs",)), ("scala", "scala", ("scala",)), ("shell", "bash", ("sh",)), ("swift", "swift6", ("swift",)), ("typescript", "ts", ("ts",)), ("zig", "zig", ("zig",)),
)
# Folders and files of an implementation that aren't part of it.
LEFT_OUT = ("tests", "test", "node_modules", "target", "build", ".git", "vendor", "obj", "bin")
TEST_STEM = r"^(?:test_.*|.*_test|.*Test|(?i:build|package|conftest))$"
# Published sizes relative to c: language, bytes, lines, tasks, deviation.
PUBLISHED = (
    ("c", 1.0, 1.0, 85, 0.0661), ("c-sharp", 0.6409, 0.5795, 144, 0.0314), ("cpp", 0.8892, 0.8393, 86, 0.0430), ("go", 0.5767, 0.6851, 148, 0.0405), ("java", 0.8213, 0.7084, 145, 0.0283), ("javascript", 0.5369, 0.5270, 139, 0.0583),
    ("kotlin", 0.5086, 0.3620, 95, 0.0414), ("php", 0.6077, 0.6470, 117, 0.0310), ("python", 0.4069, 0.3185, 140, 0.0259), ("ruby", 0.4286, 0.5279, 115, 0.0521), ("rust", 0.5937, 0.6070, 106, 0.0600), ("scala", 0.5383, 0.3954, 101, 0.0583),
    ("shell", 0.4484, 0.5232, 98, 0.0661), ("swift", 0.5842, 0.5654, 106, 0.0513), ("typescript", 0.6375, 0.6111, 111, 0.0600), ("zig", 0.6632, 0.6357, 98, 0.0544),
)
UNIT = "interpreter"


def detect(files: DataFrame) -> DataFrame:
    """(layout): rosetta, mal or exercism, the first that the paths look like; no row if none."""
    path = F.col("path")
    tracks = "|".join(t for _, t in TRACKS)
    seen = files.agg(*[F.coalesce(F.bool_or(path.rlike(rx)), F.lit(False)).alias(n) for n, rx in (("rosetta", "^Task/."), ("mal", "^impls/rust/."), ("exercism", rf"^(?:{tracks})/exercises/practice/."))])
    layout = F.when(F.col("rosetta"), "rosetta").when(F.col("mal"), "mal").when(F.col("exercism"), "exercism")
    return seen.select(layout.alias("layout")).filter("layout IS NOT NULL")


def _measured(files: DataFrame) -> DataFrame:
    """`files` (language, path, text, ...) with lines and bytes by each language's comment syntax; languages without one go."""
    syntax = {r[0]: dimensions.SYNTAXES[r[5]] for r in dimensions.LANGUAGES if r[5]}
    size = reduce(lambda c, x: c.when(F.col("language") == x[0], T.measure(F.col("text"), x[1])), list(syntax.items())[1:], F.when(F.col("language") == next(iter(syntax)), T.measure(F.col("text"), next(iter(syntax.values())))))
    out = files.filter(F.col("language").isin(*syntax)).withColumn("__m", size)
    return out.withColumns({"lines": F.col("__m.lines").cast("long"), "bytes": F.col("__m.bytes").cast("long")}).drop("__m")


def _full(samples: DataFrame) -> DataFrame:
    return samples.filter("lines > 0")


def _exact_extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def rosetta(files: DataFrame) -> DataFrame:
    """Task/<task>/<Language>/<file>: the median of a task's solutions."""
    known = F.broadcast(files.sparkSession.createDataFrame(ROSETTA, "language string, folder string, ext string"))
    at = r"^Task/([^/]+)/([^/]+)/[^/]+$"
    own = files.filter(F.col("path").rlike(at)).select("path", "text", F.regexp_extract("path", at, 1).alias("task"), F.regexp_extract("path", at, 2).alias("folder"), _exact_extension(F.col("path")).alias("ext"))
    return stats.median_samples(_full(_measured(own.join(known, ["folder", "ext"]))))


def exercism(files: DataFrame) -> DataFrame:
    """<track>/exercises/practice/<task>: the sum of the files that the exercise's settings name as its example."""
    spark = files.sparkSession
    known = F.broadcast(spark.createDataFrame(TRACKS, "language string, track string"))
    at = r"^([^/]+)/exercises/practice/([^/]+)/(.+)$"
    own = files.filter(F.col("path").rlike(at)).select("path", "text", *[F.regexp_extract("path", at, i).alias(n) for i, n in ((1, "track"), (2, "task"), (3, "rel"))]).join(known, "track")
    told = own.filter("rel = '.meta/config.json'").select("track", "task", F.from_json("text", "files struct<example:array<string>, exemplar:array<string>>").alias("c"))
    named = told.select("track", "task", F.explode(F.array_distinct(F.coalesce("c.files.example", "c.files.exemplar"))).alias("rel"))
    programs = [e for r in dimensions.LANGUAGES if r[1] == "programming" for e in r[2]]
    code = own.join(named, ["track", "task", "rel"], "left_semi").filter(extension(F.col("path")).isin(*programs))
    return _full(stats.summed_samples(_measured(code)))


def mal(files: DataFrame) -> DataFrame:
    """impls/<language>/...: the sum of a whole implementation, without tests, builds and dependencies."""
    known = F.broadcast(files.sparkSession.createDataFrame([(lang, d, e) for lang, d, es in IMPLEMENTATIONS for e in es], "language string, folder string, ext string"))
    at = r"^impls/([^/]+)/(.+)$"
    own = files.filter(F.col("path").rlike(at)).select("path", "text", F.regexp_extract("path", at, 1).alias("folder"), F.split(F.regexp_extract("path", at, 2), "/").alias("steps"), _exact_extension(F.col("path")).alias("ext"))
    stem = F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "")
    kept = own.filter(~F.arrays_overlap(F.slice("steps", F.lit(1), F.size("steps") - 1), F.array(*map(F.lit, LEFT_OUT))) & ~stem.rlike(TEST_STEM))
    return _full(stats.summed_samples(_measured(kept.join(known, ["folder", "ext"])).withColumn("task", F.lit(UNIT))))


READERS = {"rosetta": rosetta, "exercism": exercism, "mal": mal}
#: How many tasks a language must have to count.
FLOORS = {"rosetta": 50, "exercism": 50, "mal": 1}


def published(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, "language string, bytes double, lines double, tasks int, deviation double")


def published_ratios(spark: SparkSession) -> DataFrame:
    """(left, right, bytes, lines) of every two languages of the published index, left before right."""
    a, b = published(spark).alias("a"), published(spark).alias("b")
    return a.join(F.broadcast(b), F.col("a.language") < F.col("b.language")).select(F.col("a.language").alias("left"), F.col("b.language").alias("right"), *[(F.col(f"a.{m}") / F.col(f"b.{m}")).alias(m) for m in ("bytes", "lines")])


def counts(pairs: DataFrame, samples: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """One row and one column per language: how many tasks two share, and on the diagonal how many one has."""
    both = pairs.select("left", "right", "tasks").unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "tasks"))
    own = samples.groupBy(F.col("language").alias("left")).agg(F.count("*").alias("tasks")).withColumn("right", F.col("left"))
    grid = both.unionByName(own).groupBy(F.col("left").alias("language"))
    return (grid.pivot("right", languages) if languages else grid.pivot("right")).agg(F.first("tasks"))


def markdown(table: DataFrame, order: list[str]) -> str:
    """A table of few rows as text: its columns are as many as languages, and so are its rows."""
    head, *_ = columns = table.columns
    rows = sorted(table.collect(), key=lambda r: [str(r[c]) for c in order])
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "|".join(" --- " if c == head else " ---: " for c in columns) + "|"]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def report(samples: DataFrame, baseline: str, shared: int = 25) -> str:
    """Index, deviation, ratios, counts and the worst triangles of a corpus, as text."""
    found = stats.pairs(samples, shared)
    index = stats.fit(found, baseline).join(stats.deviation(found, stats.fit(found, baseline)), "language", "left")
    parts = {"Index": (index, ["language"]), "Bytes": (stats.matrix(found), ["language"]), "Lines": (stats.matrix(found, "lines"), ["language"]), "Shared tasks": (counts(found, samples), ["language"]), "Triangles": (stats.triangles(found), ["a", "b", "c"])}
    return "\n".join(f"## {title}\n\n{markdown(df, order)}" for title, (df, order) in parts.items())

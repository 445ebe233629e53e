"""Intermediate-representation dumps: lines of text to functions, instructions and a tally.

Functions are islands: the running count of begin lines, by stretches of a file. A position holds for the
instructions after its line, within a function. Stretches and functions are the units of parallel work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END = "# Begin Function AIR: ", "# End Function AIR:"
_INSTRUCTION = r"^%\s*\+?([0-9]+)\s*(!*)=(.*)$"
#: Lines that are counted together.
STRETCH = 1 << 18
SCHEMA = "file string, line_no long, value string"


def classify(lines: DataFrame) -> DataFrame:
    """`lines` (file, line_no, value) with fn (ordinal in the file, 0 before the first), body and class."""
    body = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    df = lines.withColumn("body", body)
    begins, ends = F.col("body").startswith(BEGIN), F.col("body").startswith(END)
    # The running count of begin lines, stretch by stretch: a long file isn't one task.
    df = df.withColumn("stretch", F.floor(F.col("line_no") / STRETCH))
    own = Window.partitionBy("file", "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy("file", "stretch").agg(F.sum(begins.cast("int")).alias("n"))
    base = heads.select("file", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    df = df.withColumn("fn", F.sum(begins.cast("int")).over(own)).join(base, ["file", "stretch"]).withColumn("fn", F.col("fn") + F.col("base")).drop("stretch", "base")
    # A function is open from its begin line until its first end line.
    inside = Window.partitionBy("file", "fn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(ends).over(inside), F.lit(False))
    call = F.regexp_extract("body", _INSTRUCTION, 3)
    op = F.trim(F.substring_index(F.trim(call), "(", 1))
    kind = (
        F.when(F.col("body") == "", "blank")
        .when(begins, "begin")
        .when(ends, "end")
        .when(F.col("body").startswith("#"), "header")
        .when((F.col("fn") == 0) | closed, "other")
        .when(F.col("body").startswith("}"), "delimiter")
        .when(F.col("body").rlike(r"^(%[0-9]+!\s*)+$") & F.col("body").rlike(r"^%[0-9]+!(\s+%[0-9]+!)*$"), "death")
        .when(F.col("body").rlike(_INSTRUCTION) & (op != ""), "instruction")
        .when(F.col("body").startswith("%"), "unparsed")
        .otherwise("other")
    )
    return df.withColumn("open", (F.col("fn") > 0) & ~closed).withColumn("class", kind)


def _number(text: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(F.trim(text), "^([0-9]+)", 1), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))


def functions(classified: DataFrame) -> DataFrame:
    """(file, fn, mangled, declared_instructions, read_instructions, air_bytes): a function without an end line counts."""
    b = F.col("body")
    head = lambda prefix: F.max(F.when((F.col("class") == "header") & F.col("open") & b.startswith(prefix), _number(F.substring(b, len(prefix) + 1, 64))))
    return (
        classified.filter("fn > 0")
        .groupBy("file", "fn")
        .agg(
            F.max(F.when(F.col("class") == "begin", F.regexp_replace(F.substring(b, len(BEGIN) + 1, 1 << 20), ":+$", ""))).alias("mangled"),
            F.coalesce(head("# AIR Instructions:"), F.lit(0)).cast("long").alias("declared_instructions"),
            F.count_if(F.col("class") == "instruction").alias("read_instructions"),
            F.coalesce(head("# Total AIR+Liveness bytes:"), F.lit(0)).cast("long").alias("air_bytes"),
        )
    )


def _nested(levels: int) -> str:
    """A pattern of text without a comma outside brackets, brackets nested up to `levels` deep."""
    plain, inner = r"[^,()\[\]{}<>]", ""
    for _ in range(levels):
        inner = rf"|[(\[{{<](?:[^()\[\]{{}}<>]{inner})*+[)\]}}>]"
    return rf"^(?:{plain}{inner})*+(?=,|$)"


_HEAD = _nested(4)


def leading_type(arguments: Column) -> Column:
    """The first argument at bracket depth 0, unless it is a value or a name.

    A pattern finds it where brackets nest up to four deep; a fold over the characters the others.
    """
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        ends = a["done"] | ((c == ",") & (a["depth"] == 0))
        move = F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)
        return F.struct((a["depth"] + move).alias("depth"), ends.alias("done"), F.when(ends, a["out"]).otherwise(F.concat(a["out"], c)).alias("out"))

    slow = F.aggregate(F.split(arguments, ""), zero, step, lambda a: a["out"])
    first = F.trim(F.when(arguments.rlike(_HEAD), F.regexp_extract(arguments, _HEAD, 0)).otherwise(slow))
    return F.when(first.rlike("^[%@]"), "").otherwise(first)


def instructions(classified: DataFrame) -> DataFrame:
    """(file, fn, line_no, index, op, result_type, arguments, operands, dead, depth, line, column)."""
    rows = classified.filter("fn > 0 AND class = 'instruction'")
    call = F.trim(F.regexp_extract("body", _INSTRUCTION, 3))
    has = call.contains("(")
    # All closing brackets at the end go.
    args = F.when(has, F.regexp_replace(F.expr("substring(__call, instr(__call, '(') + 1)"), r"\)+$", "")).otherwise("")
    rows = rows.withColumn("__call", call).withColumn("op", F.when(has, F.trim(F.substring_index("__call", "(", 1))).otherwise(F.col("__call"))).withColumn("arguments", args)
    is_position = (F.col("op") == "dbg_stmt") & F.col("arguments").rlike(r"^\s*[0-9]+\s*:\s*[0-9]+\s*$")
    part = lambda i: F.regexp_extract("arguments", r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$", i).cast("long")
    before = Window.partitionBy("file", "fn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda i: F.coalesce(F.last(F.when(is_position, part(i)), ignorenulls=True).over(before), F.lit(0).cast("long"))
    spaces = F.length(F.regexp_replace("value", r"(?U)\s+$", "")) - F.length("body")
    return rows.select(
        "file",
        "fn",
        "line_no",
        F.regexp_extract("body", _INSTRUCTION, 1).cast("long").alias("index"),
        "op",
        leading_type(F.col("arguments")).alias("result_type"),
        "arguments",
        F.transform(F.regexp_extract_all("arguments", F.lit("%([0-9]+)"), F.lit(1)), lambda x: x.cast("long")).alias("operands"),
        (F.regexp_extract("body", _INSTRUCTION, 2) != "").alias("dead"),
        F.greatest(F.floor(spaces / 2) - 1, F.lit(0)).cast("short").alias("depth"),
        place(1).alias("line"),
        place(2).alias("column"),
    )


def tally(classified: DataFrame) -> DataFrame:
    """(class, n): every line is in one class."""
    return classified.groupBy("class").agg(F.count("*").alias("n"))


def balances(classified: DataFrame) -> DataFrame:
    """One row: lines, how many are in a known class, and whether none is left over."""
    known = ["blank", "begin", "end", "header", "delimiter", "death", "instruction", "unparsed", "other"]
    out = classified.agg(F.count("*").alias("lines"), F.count_if(F.col("class").isin(*known)).alias("counted"))
    return out.withColumn("balanced", F.col("lines") == F.col("counted"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Dump files as numbered lines, read in splits, so that a file of any size is many tasks.

    A line's number is its place in its split, which Spark counts up within a task, after the lines of the splits before.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__n"), "value")
    splits = lines.groupBy("file", "__at").agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    # A row per split of a file: few.
    before = Window.partitionBy("file").orderBy("__at")
    base = splits.withColumn("__base", F.sum("__size").over(before) - F.col("__size")).select("file", "__at", (F.col("__base") - F.col("__first")).alias("__move"))
    return lines.join(F.broadcast(base), ["file", "__at"]).select("file", (F.col("__n") + F.col("__move")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def numbered(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, instructions) with id: functions are numbered from 0 over all files, in the order of files and lines."""
    made = functions(classified)
    # A row per file: the running sum is a small window.
    files = made.groupBy("file").agg(F.max("fn").alias("n"))
    base = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("__base"))
    ids = lambda df: df.join(F.broadcast(base), "file").withColumn("id", F.col("fn") - 1 + F.col("__base")).drop("__base")
    return ids(made), ids(instructions(classified))


def write_store(classified: DataFrame, path: str) -> None:
    """Both tables as zstd Parquet; functions are numbered from 0 over all files."""
    for name, df in zip(("functions", "instructions"), numbered(classified)):
        df.withColumn("fn", F.col("fn") - 1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

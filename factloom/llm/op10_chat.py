"""Chat formatting by quotation linking.

Each message is parsed into its own words and quoted passages with their levels ('>' marks, nested).
Normalised passages are hashed and joined to the messages whose own words they are: the first message of
the same conversation that wrote the passage before, else the first of any other conversation; passages
of under MIN_CHARS characters, which many write by chance, link within their conversation alone. What a message
quotes first, at the outermost level, it replies to; without a quote it replies to the message before, if there is one.

Conversations that reply into one another make a thread: each has at most one that it continues, that of its
first reply out of it. The result is one row per message, without quotes; ordered by (thread, depth, conversation, turn),
where depth is how many conversations stand before, a thread reads in reply order. Where conversations reply to one another
in a circle, only their replies to lesser ids count for thread and depth.

Only hashes and ids are joined; units are pre-aggregated to one row per conversation and hash, and hot hashes are joined by
broadcast, so that neither a line that everyone writes or quotes nor a conversation with a third of all rows is
one task.

Edge cases: a null or empty text has no passage and an empty text; a quote whose source isn't found
is taken out all the same and leaves no link; equal messages link to the first; null conversation ids
link across conversations alone, and have no thread; rows that repeat are kept, each; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, load, spread_join, stored, whole
from .components import components

MIN_CHARS = 8
_MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_WROTE = re.compile(r"(?:^|\n)[^\n]{0,200}\b(?:wrote|writes|schrieb|écrit|a écrit|escribió)\s?:[ \t]*\n*\Z", re.I)
_MESSAGE = "own string, units array<string>, quotes array<struct<level:int,hash:string,n:int,short:boolean>>"
#: Turns of a conversation that are put in order together.
STRETCH = 1024


def normalised(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


def digest(text: str) -> str | None:
    """The hash of a passage in normal form, or as it stands if it has no words; none for blanks."""
    plain = normalised(text) or " ".join(text.split())
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if plain else None


def is_short(text: str) -> bool:
    """Whether a passage is too short to tell whose it is outside its conversation."""
    return len(normalised(text)) < MIN_CHARS


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own words, [(level, quoted passage)]): a passage is a run of lines of one level."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _MARK.match(line)
        if not m:
            own.append(line)
            last = 0
            continue
        if last == 0:  # the line that says who wrote what follows is part of the quote
            head = _WROTE.sub("", "\n".join(own))
            own = head.split("\n") if head else []
        level, rest = m[1].count(">"), line[m.end() :]
        if level != last:
            passages.append((level, []))
        passages[-1][1].append(rest)
        last = level
    return "\n".join(own).strip() if passages else text, [(n, "\n".join(p).strip()) for n, p in passages if "".join(p).strip()]


def units(own: str) -> list[str]:
    """Hashes of what can be quoted of a message: all of it, each paragraph, each line."""
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return sorted({d for p in parts if (d := digest(p))})


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """`messages`, their text replaced by own, units and quotes (level, hash, order, short)."""
    names = [c for c in messages.columns if c != text]
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("n", pa.int32()), ("short", pa.bool_())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        owns, unit, quotes = [], [], []
        for t in b.column(len(names)).to_pylist():
            own, passages = parse(t)
            owns.append(own)
            unit.append(units(own))
            # A passage is looked for as a whole, then line by line.
            found = [(n, d, i, is_short(q)) for i, (n, p) in enumerate(passages) for d, q in {digest(q): q for q in [p, *p.split("\n")]}.items() if d]
            quotes.append([{"level": n, "hash": d, "n": i, "short": short} for n, d, i, short in found])
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(owns, pa.string()), pa.array(unit, pa.list_(pa.string())), pa.array(quotes, kind)], names=[*names, "own", "units", "quotes"])

    schema = "".join(f"`{c}` {messages.schema[c].dataType.simpleString()}, " for c in names)
    return arrow_map(messages.select(*names, whole(text).alias("__t")), run, schema + _MESSAGE)


def _preceded(rows: DataFrame) -> DataFrame:
    """`rows` with `before`, the greatest lesser turn of the conversation; in stretches, so that a long one isn't one group."""
    part = F.floor(F.col("turn") / STRETCH)
    cut = rows.withColumn("part", part)
    ends = cut.groupBy("conv", "part").agg(F.max("turn").alias("end"))
    ends = ends.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.lag("end").over(Window.partitionBy("conv").orderBy("part")).alias("last"))
    lesser = F.max("turn").over(Window.partitionBy("conv", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("lesser", lesser).join(ends, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return placed.withColumn("before", F.when(F.col("conv").isNotNull(), F.coalesce("lesser", "last"))).drop("part", "lesser", "c", "p", "last")


def threads(links: DataFrame) -> DataFrame:
    """(conv, thread, depth) of the conversations in `links` (conv, after), where a conv stands once and continues another."""
    scratch = Scratch(links.sparkSession)
    links = scratch.put(links, "chat-links")
    total = links.count()
    if not total:
        kind = links.schema["conv"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"conv {kind}, thread {kind}, depth int")
    ends = links.select("conv").union(links.select(F.col("after").alias("conv"))).distinct()
    roots = components(links.select(F.col("conv").alias("u"), F.col("after").alias("v")), scratch)
    grouped = ends.join(roots.withColumnRenamed("u", "conv"), "conv", "left").select("conv", F.coalesce("root", "conv").alias("thread"))
    grouped = scratch.put(grouped.join(links, "conv", "left"), "chat-threads")
    # Each thread has one conversation that continues none, or else one circle.
    headed = grouped.filter("after IS NULL").select("thread")
    steps = grouped.filter("after IS NOT NULL")
    steps = steps.join(headed.withColumn("headed", F.lit(True)).hint("merge"), "thread", "left").filter("headed OR after < conv")
    # Ancestors 1, 2, 4 ... steps before, until none has one.
    now = scratch.put(steps.select("conv", F.col("after").alias("anc"), F.lit(1).alias("hops")), "chat-depth")
    for _ in range(40):
        far = now.select(F.col("conv").alias("anc"), F.col("anc").alias("next"), F.col("hops").alias("more"))
        step = spread_join(now, far, ["anc"], total, "left")
        moved = step.select("conv", F.coalesce("next", "anc").alias("anc"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved"))
        now = scratch.put(moved, "chat-depth")
        if not now.filter("moved").limit(1).count():
            depth = now.select("conv", F.col("hops").alias("depth"))
            return grouped.join(depth.hint("merge"), "conv", "left").select("conv", "thread", F.coalesce("depth", F.lit(0)).alias("depth"))
    raise RuntimeError("threads of conversations not done after 40 rounds")


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, reply_conv, reply_turn, thread, depth, n_quotes, n_linked, text): one row per message, its quotes taken out."""
    fixed = {"reply_conv", "reply_turn", "thread", "depth", "n_quotes", "n_linked"}
    if len(fixed | {conv, turn, role, text}) < 10:
        raise ValueError(f"names of the result clash: {conv}, {turn}, {role}, {text}")
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = stored(parsed(rows), "chat-messages")
    quotes = rows.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.level", "q.hash", "q.n", "q.short").distinct()
    quotes = stored(quotes, "chat-quotes")
    n_quotes = quotes.count()
    # Only what someone quotes is looked for; of a conversation's copies of a passage the first.
    wanted = quotes.groupBy("hash").agg(F.first("short").alias("unfit"))
    written = rows.select("conv", "turn", F.explode("units").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("src_turn"))
    n_units = rows.agg(F.sum(F.size("units"))).first()[0] or 0
    first = stored(spread_join(written, wanted, ["hash"], n_units), "chat-sources")
    # Of each hash the least sources of two conversations: one of them isn't the quoting one.
    source = F.struct(F.col("conv").isNull().alias("none"), "conv", "src_turn")
    least = first.filter("NOT unfit").groupBy("hash").agg(F.min(source).alias("a"))
    second = spread_join(first.filter("NOT unfit"), least, ["hash"], n_units).filter(~F.col("conv").eqNullSafe(F.col("a.conv"))).groupBy("hash").agg(F.min(source).alias("b"))
    anywhere = least.join(second, "hash", "left")
    here = first.filter("conv IS NOT NULL").select("conv", "hash", "src_turn")
    near = spread_join(quotes.filter("conv IS NOT NULL"), here, ["conv", "hash"], n_quotes, "left").unionByName(quotes.filter("conv IS NULL").withColumn("src_turn", F.lit(None).cast(rows.schema["turn"].dataType)))
    far = spread_join(near, anywhere, ["hash"], n_quotes, "left")
    other = F.when(F.col("a").isNotNull() & ~F.col("a.conv").eqNullSafe(F.col("conv")), F.col("a")).otherwise(F.col("b"))
    place = F.when(F.col("src_turn") < F.col("turn"), F.struct(F.col("conv").alias("c"), F.col("src_turn").alias("t"))).when(other.isNotNull(), F.struct(other["conv"].alias("c"), other["src_turn"].alias("t")))
    hits = far.select("conv", "turn", "level", "n", "short", place.alias("src")).filter("src.t IS NOT NULL")
    replies = hits.groupBy("conv", "turn").agg(F.min_by("src", F.struct("level", "n", "short", "src")).alias("src"), F.count_distinct("n").alias("n_linked"))
    replies = stored(replies, "chat-replies")
    away = replies.filter("conv IS NOT NULL AND src.c IS NOT NULL AND src.c <> conv")
    placed = threads(away.groupBy("conv").agg(F.min_by("src.c", F.struct("turn", "src")).alias("after")))
    passages = F.size(F.array_distinct(F.transform("quotes", lambda q: q["n"])))
    turns = _preceded(rows).select("conv", "turn", "role", "before", passages.alias("n_quotes"), F.col("own").alias("text"))
    out = turns.alias("m").join(replies.alias("r"), F.col("m.conv").eqNullSafe(F.col("r.conv")) & F.col("m.turn").eqNullSafe(F.col("r.turn")), "left")
    before = F.col("m.before")
    out = out.select(
        F.col("m.conv").alias("conv"),
        F.col("m.turn").alias(turn),
        F.col("m.role").alias(role),
        F.coalesce("r.src.c", F.when(before.isNotNull(), F.col("m.conv"))).alias("reply_conv"),
        F.when(F.col("r.src.t").isNotNull(), F.col("r.src.t")).otherwise(before).alias("reply_turn"),
        "m.n_quotes",
        F.coalesce("r.n_linked", F.lit(0)).cast("int").alias("n_linked"),
        F.col("m.text").alias(text),
    )
    known = out.filter("conv IS NOT NULL")
    out = spread_join(known, placed, ["conv"], rows.count(), "left", counts=rows.groupBy("conv").agg(F.count("*").alias("n")).filter("conv IS NOT NULL")).unionByName(out.filter("conv IS NULL"), allowMissingColumns=True)
    return out.select(F.col("conv").alias(conv), turn, role, "reply_conv", "reply_turn", F.coalesce("thread", "conv").alias("thread"), F.when(F.col("conv").isNotNull(), F.coalesce("depth", F.lit(0))).alias("depth"), "n_quotes", "n_linked", text)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of `conversations`: what it replies to, and its text without quotes."""
    return linked(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))

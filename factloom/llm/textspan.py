"""Native span finding: where each match of a pattern stands, in code points, without Python.

`split` gives what lies between the matches and `regexp_extract_all` the matches, so that the
running sum of both lengths is each match's place. Linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,hit:string,pre:string,post:string>>"
CONTEXT = 48


def places(gaps: Column, hits: Column, context: int = CONTEXT) -> Column:
    """array<struct<start, end, hit, pre, post>>; pre and post are the `context` characters beside a match."""
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            x["hit"].alias("hit"),
            F.right(x["gap"], F.lit(context)).alias("pre"),
            F.lit("").alias("post"),
        )
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.lit("").alias("last"),
            F.when(x["hit"].isNotNull(), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    spans = F.aggregate(pairs, none, step, lambda acc: acc["out"])
    after = F.transform(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.left(g, F.lit(context)))
    return F.zip_with(
        spans,
        after,
        lambda s, a: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["pre"].alias("pre"), F.coalesce(a, F.lit("")).alias("post")),
    )


def gaps_of(text: Column, pattern: str, wanted: Column) -> Column:
    """What lies between the matches; [the text] where `wanted`, a cheap test that a match needs, is false."""
    return F.when(wanted, F.split(text, pattern, -1)).otherwise(F.array(text))


def hits_of(text: Column, pattern: str, wanted: Column, group: int = 0) -> Column:
    return F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs with these fields."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

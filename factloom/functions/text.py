"""Comment stripping and measurement, as native expressions: the scanner is one regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import Syntax

EDGES = r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$"


def pattern(syntax: Syntax, possessive: bool = True) -> str:
    """Tokens of a text, leftmost first: multi-quotes, block comments, line comments, quotes, what lies between.

    possessive keeps Java from recursing over long quotes; other engines don't know the form.
    """
    p = "+" if possessive else ""
    parts = [f"{re.escape(q)}{_inside(q, possessive)}(?:{re.escape(q)}|\\\\?\\z)" for q in sorted(syntax.multi_quotes, key=len, reverse=True)]
    parts += [f"{re.escape(a)}(?s:.*?)(?:{re.escape(b)}|\\z)" for a, b in syntax.block]
    parts += [f"{re.escape(m)}[^\\n]*" for m in sorted(syntax.line, key=len, reverse=True)]
    parts += [f"{q}(?:[^\\\\\\n{q}]+{p}|(?s:\\\\.))*{p}(?:{q}|\\n|\\\\?\\z)" for q in syntax.quotes]
    first = "".join(sorted({re.escape(m[0]) for m in [*syntax.multi_quotes, *(a for a, _ in syntax.block), *syntax.line, *syntax.quotes]}))
    return "|".join([*parts, f"[^{first}]+", "(?s:.)"])


def _inside(quote: str, possessive: bool) -> str:
    """What a quote over lines holds: anything up to its end, a backslash with what follows."""
    if not possessive:
        return "(?s:(?:[^\\\\]|\\\\.)*?)"
    c = re.escape(quote[0])
    alone = f"|{c}(?!{re.escape(quote[1:])})" if len(quote) > 1 else ""
    return f"(?s:(?:[^\\\\{c}]++|\\\\.{alone})*+)"


def strip_comments(text: Column, syntax: Syntax) -> Column:
    """The text without comments: a block comment leaves the line feeds it holds."""
    tokens = F.regexp_extract_all(text, F.lit(pattern(syntax)), F.lit(0))

    def keep(t: Column) -> Column:
        out = t
        for a, _ in syntax.block:
            out = F.when(t.startswith(a), F.regexp_replace(t, r"[^\n]", "")).otherwise(out)
        for m in syntax.line:
            out = F.when(t.startswith(m), F.lit("")).otherwise(out)
        return out

    return F.array_join(F.transform(tokens, keep), "")


def lines_of(text: Column) -> Column:
    """The trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")


def measure(text: Column, syntax: Syntax | None) -> Column:
    """struct<lines, bytes> of the code; null for a language without a comment syntax."""
    if syntax is None:
        return F.lit(None).cast("struct<lines:long,bytes:long>")
    code = lines_of(strip_comments(F.coalesce(text, F.lit("")), syntax))
    size = F.aggregate(code, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return F.struct(F.size(code).cast("long").alias("lines"), size.alias("bytes"))


def measure_sql(text: str, syntax: Syntax) -> str:
    """The same for a second engine: an expression of a list of trimmed lines."""
    pat = pattern(syntax, possessive=False).replace("'", "''")
    cases = [f"when starts_with(t, '{m}') then ''" for m in syntax.line] + [f"when starts_with(t, '{a}') then regexp_replace(t, '[^\\n]', '', 'g')" for a, _ in syntax.block]
    joined = f"array_to_string(list_transform(regexp_extract_all(coalesce({text}, ''), '{pat}'), lambda t: case {' '.join(cases)} else t end), '')"
    trimmed = f"list_transform(string_split({joined}, chr(10)), lambda x: regexp_replace(x, '{EDGES}', '', 'g'))"
    return f"list_filter({trimmed}, lambda x: x <> '')"


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trim(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")

"""Rewrites that let a grammar read a language's newer or macro-ridden source; no byte moves, so spans stay right.

A rule looks at a text and answers with edits (start, end, bytes of the same length); the driver applies one rule
after another. A rewrite keeps the source's meaning, or narrows it (something is no longer said). Texts are bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edit = tuple[int, int, bytes]
_OPEN, _CLOSE = b"([{", b")]}"
_BRACKET = re.compile(rb"[()\[\]{}]")


class Text:
    """A source with what the rules ask of it: neighbours, lines, brackets."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def line_starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer(rb"\n", self.raw))]

    @cached_property
    def closers(self) -> dict[int, int]:
        """Of each opening bracket the place behind the one that closes it, whatever the kinds."""
        out, waiting = {}, []
        for m in _BRACKET.finditer(self.raw):
            if m[0] in _OPEN:
                waiting.append(m.start())
            elif waiting:
                out[waiting.pop()] = m.end()
        return out

    def line_before(self, at: int) -> bytes:
        return self.raw[self.line_starts[bisect_right(self.line_starts, at) - 1] : at]

    def in_directive(self, at: int) -> bool:
        """Whether the place is on a preprocessor's line."""
        return self.line_before(at).lstrip().startswith(b"#")

    def opens_line(self, at: int) -> bool:
        return not self.line_before(at).strip(b" \t")

    def stands_alone(self, start: int, end: int) -> bool:
        """Whether no letter, digit or underscore touches the span."""
        before = self.raw[max(0, start - 4) : start].decode("utf-8", "ignore")[-1:]
        after = self.raw[end : end + 4].decode("utf-8", "ignore")[:1]
        return not any(c.isalnum() or c == "_" for c in (before, after) if c)

    def heads(self, word: bytes) -> Iterator[tuple[int, int]]:
        for m in re.finditer(re.escape(word), self.raw):
            if self.stands_alone(*m.span()):
                yield m.span()

    def call(self, end: int) -> tuple[int, int] | None:
        """(opening bracket, place behind the closing one) of the argument list after a word that ends at `end`."""
        m = re.compile(rb"[ \t]*\(").match(self.raw, end)
        close = self.closers.get(m.end() - 1) if m else None
        return (m.end() - 1, close) if close else None

    def arguments(self, opening: int, close: int) -> list[tuple[int, int]]:
        """The arguments between two brackets, cut at commas outside inner ones; blanks before them and empty ones left out."""
        cuts, at = [opening], opening + 1
        while at < close - 1:
            if self.raw[at] in _OPEN:
                at = self.closers.get(at, at + 1)
                continue
            if self.raw[at] == 44:
                cuts.append(at)
            at += 1
        spans = [(a + 1, b) for a, b in zip(cuts, [*cuts[1:], close - 1])]
        return [(b - len(rest), b) for a, b in spans if (rest := self.raw[a:b].lstrip())]

    def until(self, start: int, word: bytes | None, stops: bytes) -> int | None:
        """Where, outside brackets, `word` comes before any of `stops`; without a word, where the first of them or a closing bracket is."""
        at = start
        while at < len(self.raw):
            if word and self.raw.startswith(word, at):
                return at
            byte = self.raw[at]
            if byte in stops or byte in _CLOSE:
                return None if word else at
            at = self.closers.get(at, len(self.raw)) if byte in _OPEN else at + 1
        return None


def blanked(raw: bytes) -> bytes:
    """Blanks of the same length; line ends stay."""
    return re.sub(rb"[^\r\n]", b" ", raw)


def names_type(argument: bytes) -> bool:
    """Whether an argument is `struct`, `union` or `enum` and a tag, perhaps with stars."""
    text = argument.decode("utf-8", "replace").strip().removeprefix("const").strip()
    return bool(re.fullmatch(r"(?:struct|union|enum)\s+[\w*][\w* ]*", text))


def without_generics(text: bytes) -> bytes:
    """`text` without the angle brackets it ends with."""
    depth = 0
    for m in reversed(list(re.finditer(rb"[<>]", text))) if text.endswith(b">") else ():
        depth += 1 if m[0] == b">" else -1
        if not depth:
            return text[: m.start()]
    return text


def trailing_word(text: bytes) -> str:
    return re.search(r"\w*\Z", text.decode("utf-8", "ignore"))[0]


@dataclass(frozen=True)
class Blank:
    """A word becomes blanks: between the given neighbours, and at a line's head if `leading`; not on a preprocessor's line."""

    word: str
    after: str | None = None
    before: str | None = None
    leading: bool = False
    narrows = False

    def edits(self, t: Text) -> Iterable[Edit]:
        for start, end in t.heads(self.word.encode()):
            fits = not self.leading or t.opens_line(start)
            if fits and self.after:
                fits = without_generics(t.raw[:start].rstrip()).rstrip().endswith(self.after.encode())
            if fits and self.before:
                fits = t.raw[end:].lstrip().startswith(self.before.encode())
            if fits and not t.in_directive(start):
                yield start, end, b" " * (end - start)


@dataclass(frozen=True)
class CallToIf:
    """A call at a line's head, a loop in disguise, becomes a condition."""

    word: str
    narrows = True

    def edits(self, t: Text) -> Iterable[Edit]:
        for start, end in t.heads(self.word.encode()):
            if t.opens_line(start) and t.raw[end:].lstrip(b" \t").startswith(b"("):
                yield start, end, b"if".rjust(end - start)


@dataclass(frozen=True)
class BlankInvocation:
    """A call becomes blanks, with a `static` before it and a semicolon behind it."""

    word: str
    narrows = True

    def edits(self, t: Text) -> Iterable[Edit]:
        done = 0
        for start, end in t.heads(self.word.encode()):
            span = None if start < done or t.in_directive(start) else t.call(end)
            if span:
                before = re.search(rb"static[ \t]*\Z", t.raw[max(0, start - 64) : start])
                first = start - len(before[0]) if before else start
                if before and not t.stands_alone(first, first + 6):
                    first = start
                done = re.compile(rb"(?:[ \t]*;)?").match(t.raw, span[1]).end()
                yield first, done, blanked(t.raw[first:done])


def _zero(raw: bytes) -> bytes:
    """A zero in place of an argument."""
    return b"0" + blanked(raw)[1:]


@dataclass(frozen=True)
class TypeArgument:
    """Arguments of a call that name a type become zeros."""

    word: str
    narrows = True

    def edits(self, t: Text) -> Iterable[Edit]:
        done = 0
        for start, end in t.heads(self.word.encode()):
            span = None if start < done or t.in_directive(start) else t.call(end)
            if span:
                done = span[1]
                yield from ((a, b, _zero(t.raw[a:b])) for a, b in t.arguments(*span) if names_type(t.raw[a:b]))


@dataclass(frozen=True)
class ZeroArgument:
    """One argument of a call, a type by its place, becomes a zero."""

    word: str
    place: int
    narrows = True

    def edits(self, t: Text) -> Iterable[Edit]:
        done = 0
        for start, end in t.heads(self.word.encode()):
            span = None if start < done or t.in_directive(start) else t.call(end)
            found = t.arguments(*span)[self.place : self.place + 1] if span else []
            for a, b in found:
                if t.raw[a:b].strip() != b"0":
                    done = span[1]
                    yield a, b, _zero(t.raw[a:b])


@dataclass(frozen=True)
class TypeCondition:
    """A condition where a type is due becomes its `else` branch."""

    word: str = "if"
    narrows = True

    def edits(self, t: Text) -> Iterable[Edit]:
        done = 0
        for start, end in t.heads(b"if"):
            if start < done or not self._type_is_due(t.raw[:start].rstrip()):
                continue
            m = re.compile(rb"\s*\(").match(t.raw, end)
            close = t.closers.get(m.end() - 1) if m else None
            other = t.until(close, b"else", b",;=") if close else None
            stop = t.until(other + 4, None, b"{,;=") if other else None
            kept = t.raw[other + 4 : stop].strip() if stop else b""
            if kept:
                done = stop
                yield start, stop, kept.ljust(stop - start)

    @staticmethod
    def _type_is_due(before: bytes) -> bool:
        if before.endswith((b"]", b"?", b":")):
            return True
        head = before[:-1].rstrip()
        if not before.endswith(b"!"):
            return False
        word = trailing_word(head)
        return head.endswith(b")") or bool(word) and word not in NEGATED


# Words after which an exclamation mark negates.
NEGATED = ("and", "or", "return", "if", "while", "for", "else", "try", "comptime", "orelse", "break")
# Of each language its rewrites, in the order they are applied.
TABLES = {
    "rust": (
        Blank("const", before="trait"), Blank("const", after="impl"), Blank("[const]"), Blank("~const"), Blank("become"), Blank("raw const", after="&"), Blank("raw mut", after="&"), Blank("yield"), Blank("try", before="{"), Blank("auto", before="trait"),
    ),
    "zig": (TypeCondition(),),
    "python": (Blank("lazy", before="import", leading=True), Blank("lazy", before="from", leading=True)),
    "c": (
        *map(Blank, "UNUSED MAYBE_UNUSED NORETURN_PTR NORETURN LAST_ARG_MUST_BE_NULL RESULT_MUST_BE_USED REFTABLE_UNUSED WINAPI NTAPI".split()),
        *map(CallToIf, "for_each_string_list_item strmap_for_each_entry strintmap_for_each_entry strset_for_each_entry hashmap_for_each_entry_from hashmap_for_each_entry list_for_each_safe list_for_each_prev list_for_each_dir list_for_each prio_queue_for_each repo_for_each_pack for_each_wanted_builtin for_each_builtin".split()),
        *map(BlankInvocation, "define_commit_slab declare_commit_slab define_shared_commit_slab implement_shared_commit_slab implement_commit_slab DEFINE_LIST_SORT_DEBUG DEFINE_LIST_SORT DECLARE_LIST_SORT REPO_GIT_PATH_FUNC GIT_PATH_FUNC KHASH_INIT FOREACH_FSCK_MSG_ID DECLARE_PROC_ADDR libc_hidden_def strong_alias SHA1_STORE_STATE SHA1_RECOMPRESS FORMAT_PRESERVING".split()),
        *map(TypeArgument, "hashmap_clear_and_free hashmap_partial_clear_and_free hashmap_iter_first_entry hashmap_get_entry_from_hash hashmap_get_entry list_first_entry list_last_entry container_of_or_null container_of list_entry".split()),
        ZeroArgument("va_arg", 1), ZeroArgument("maximum_unsigned_value_of_type", 0),
        *map(Blank, "_In_opt_ _In_ _Reserved_".split()), Blank("DISPLAY_PREFIX", after="ANSI_PREFIX"),
        Blank("UNITTEST_BEGIN_SIMPLE"), BlankInvocation("UNITTEST_BEGIN"), Blank("UNITTEST_END_SIMPLE"), BlankInvocation("UNITTEST_END"), Blank("UNITTEST_STOP"),
        Blank("JEMALLOC_ALWAYS_INLINE"), Blank("JEMALLOC_NOINLINE"), Blank("JEMALLOC_EXPORT"), Blank("TEST_END"), BlankInvocation("TEST_BEGIN"),
    ),
}


def neutralize(language: str | None, source: str | None) -> tuple[str, list[str], bool] | None:
    """(the rewritten source, the rules that applied, whether one narrows); nothing if none applied."""
    if source is None or language not in TABLES:
        return None
    raw, applied, narrowed = source.encode("utf-8", "surrogatepass"), [], False
    for rule in TABLES[language]:
        if rule.word.encode() not in raw:
            continue
        edits = list(rule.edits(Text(raw)))
        if edits:
            out = bytearray(raw)
            for a, b, new in edits:
                out[a:b] = new
            raw, narrowed = bytes(out), narrowed or rule.narrows
            applied.append(f"{type(rule).__name__}:{rule.word}")
    return (raw.decode("utf-8", "surrogatepass"), applied, narrowed) if applied else None


def rewrites(files: DataFrame, language: str = "language", text: str = "text") -> DataFrame:
    """`files` with rewritten (null if nothing applied), rewrites and narrowed."""
    columns = files.columns

    def run(batches):
        for b in batches:
            found = [neutralize(x, t) for x, t in zip(b[language], b[text])]
            new = pd.DataFrame({"rewritten": [f and f[0] for f in found], "rewrites": [f[1] if f else [] for f in found], "narrowed": [bool(f and f[2]) for f in found]})
            yield pd.concat([b.reset_index(drop=True), new], axis=1)

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns)
    return files.mapInPandas(run, f"{schema}, rewritten string, rewrites array<string>, narrowed boolean")


def rule_table(spark) -> DataFrame:
    """(language, place, rule, word, narrows): the tables as rows."""
    rows = [(lang, i, type(r).__name__, r.word, r.narrows) for lang, rules in TABLES.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "language string, place int, rule string, word string, narrows boolean").orderBy(F.col("language"), "place")

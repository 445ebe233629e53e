"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Native: DataFrame expressions only. Edge cases: a null or empty text has no span and counts of 0;
repeated rows are handled row by row; an empty table gives an empty result; extra columns of the input are kept by
`annotate` and `redact`, whatever their names, but a column pii_spans, which `annotate` adds, raises a clear error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import span_sql
from .common import load, whole
from .textspan import CONTEXT, gaps_of, hits_of, joined, places

# Possessive forms of the base patterns: they match the same text, but never scan a run twice.
# \G lets an address begin where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Score of a confirmed span, before the words beside it are read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.95, "ssn": 0.4}
CONTEXT_WORDS = {
    "email": "e-?mail|contact|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax id|taxpayer",
}
BONUS = 0.3
#: Kinds beyond the base need this score to stand.
THRESHOLD = 0.5
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit fits the others: every second digit from the right counts double, 9 cast out."""
    row = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(row, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.expr("''"), F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(c == "", a).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (F.try_to_number(bare, F.lit("999")) <= 255)


def confirmed(kind: str, hit: Column) -> Column:
    """The validator of a kind: a checksum or a bound."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _small)
    if kind == "card":
        return F.length(_digits(hit)).between(16, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _wanted(kind: str, text: Column, digit: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+") & digit}.get(kind, digit)


def _stage(docs: DataFrame, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """(row, __text, and __gaps_k and __hits_k of each kind, each computed once); row holds all columns, whatever their names."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(F.col(f"`{text}`")).alias("__text"))
    df = df.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    cols = {}
    for k in kinds:
        want = _wanted(k, F.col("__text"), F.col("__digit"))
        cols[f"__gaps_{k}"] = gaps_of(F.col("__text"), PATTERNS[k], want)
        cols[f"__hits_{k}"] = hits_of(F.col("__text"), PATTERNS[k], want)
    return df.withColumns(cols)


def _beside(s: Column) -> Column:
    """The CONTEXT characters of the whole text before a span and those after it."""
    text, start = F.col("__text"), F.greatest(s["start"] - CONTEXT, F.lit(0))
    return F.lower(F.concat_ws(" ", F.substring(text, start + 1, s["start"] - start), F.substring(text, s["end"] + 1, F.lit(CONTEXT))))


def _scored(kind: str) -> Column:
    found = F.filter(places(F.col(f"__gaps_{kind}"), F.col(f"__hits_{kind}")), lambda s: confirmed(kind, s["hit"]))

    def score(s: Column) -> Column:
        near = _beside(s).rlike(CONTEXT_WORDS[kind])
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))).alias("score"),
        )

    spans = F.transform(found, score)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def _spans(docs: DataFrame, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """(row, __text, pii_spans): the confirmed spans of `kinds`."""
    df = _stage(docs, text, kinds)
    df = df.withColumns({f"__spans_{k}": _scored(k) for k in kinds})
    return df.withColumn("pii_spans", F.concat(*[F.col(f"__spans_{k}") for k in kinds]).cast(SPANS))


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `pii_spans`, array<struct<kind, start, end, score>>: by kind as in KINDS, then by start.

    Offsets are code points, the end exclusive. Base kinds stay whatever their score.
    """
    if "pii_spans" in docs.columns:
        raise ValueError("the input already has a column pii_spans")
    return _spans(docs, text, KINDS).select("row.*", "pii_spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span that `annotate` confirms replaced by its kind in brackets.

    Spans that overlap become one, named after the first. What only shows once its neighbours are
    replaced (digits that ran into an account number) is replaced kind after kind.
    """
    df = docs
    for kinds in (KINDS, *[(k,) for k in ("email", "iban", "card", "phone", "ssn", "ip")]):
        found = _spans(df, text, kinds)
        df = found.select(*[_masked(F.col("__text")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return df


def _masked(text: Column) -> Column:
    """The text with its pii_spans replaced."""
    order = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        piece = F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.when(F.size("pii_spans") == 0, text).otherwise(
        F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, all spans."""
    found = annotate(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def oracle_sql() -> str:
    """The same rows by a second engine."""
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    part = lambda i: f"coalesce(try_cast(regexp_replace(split_part(hit, '.', {i}), '^0+', '') as hugeint), case when length(regexp_replace(split_part(hit, '.', {i}), '^0+', '')) = 0 then 0 else 256 end) <= 255"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when (length({digits}) - i) % 2 = 0 then substr({digits}, i, 1)::int else (2 * substr({digits}, i, 1)::int) // 10 + (2 * substr({digits}, i, 1)::int) % 10 end)) % 10 = 0"
    plain = "replace(hit, ' ', '')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    mod97 = f"list_reduce(list_prepend(0::bigint, list_transform(string_split({turned}, ''), lambda c: case when c between '0' and '9' then c::bigint else ascii(c) - 55 end)), lambda a, v: (a * (case when v > 9 then 100 else 10 end) + v) % 97) = 1"
    beside = f"lower(substr(text, greatest(s - {CONTEXT}, 0) + 1, s - greatest(s - {CONTEXT}, 0)) || ' ' || substr(text, e + 1, {CONTEXT}))"
    parts = [
        span_sql.spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        span_sql.spans("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", " and ".join(map(part, range(1, 5)))),
        span_sql.spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) between 16 and 19 and {luhn}"),
        span_sql.spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 8 and 15"),
        span_sql.spans("iban", 4, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", f"length({plain}) between 15 and 34 and {mod97}", "[^A-Za-z0-9]|^", "$|[^A-Za-z0-9]"),
        f"select * from ({span_sql.spans('ssn', 5, '[0-9]{3}-[0-9]{2}-[0-9]{4}', 'true', '[^0-9-]|^', '$|[^0-9-]')}) where not regexp_matches(hit, '^(000|666|9..)|-00-|-0000$') and regexp_matches({beside}, {span_sql.quoted(CONTEXT_WORDS['ssn'])})",
    ]
    count = lambda i, k: f"count(*) filter (where rank = {i}) as n_{k}"
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents), f as (select *, rank as o1, s as o2 from ({' union all '.join(parts)}))
select t.doc_id, {', '.join(count(i, k) for i, k in enumerate(BASE))}, sha256({span_sql.joined('rank < 4')}) as base_sha256, {span_sql.joined('rank is not null')} as spans from t left join f using (doc_id) group by t.doc_id"""

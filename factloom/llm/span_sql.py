"""SQL of a second engine for span finding: its patterns know no look-around, so that neighbours are matched and taken off."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(kind: str, rank: int, pattern: str, keep: str = "true", lead: str = "", tail: str = "") -> str:
    """Rows (doc_id, rank, kind, s, e, hit) of t (doc_id, text): `lead` and `tail` must stand beside the match (a character before a bare ^); `keep` judges `hit`."""
    whole = f"(?:{lead or ''})(?:{pattern})(?:{tail or ''})" if lead or tail else pattern
    before = f"length(regexp_extract(h, {quoted('^(?:' + lead + ')')}))" if lead else "0"
    own = f"regexp_extract(substr(h, {before} + 1), {quoted('^(?:' + pattern + ')')})" if lead or tail else "h"
    return f"""select doc_id, {rank} as rank, {quoted(kind)} as kind, s + {before} as s, s + {before} + length({own}) as e, {own} as hit, text from (
 select doc_id, text, h, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i-1], lambda x: length(x))), 0))::bigint as s from (
  select doc_id, text, hs, g, unnest(hs) as h, unnest(range(1, len(hs) + 1)) as i from (
   select doc_id, text, regexp_extract_all(text, {quoted(whole)}) as hs, string_split_regex(text, {quoted(whole)}) as g from t))) where {keep}"""


def joined(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by o1, o2) filter (where {where}), '')"

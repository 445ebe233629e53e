"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_decontaminate import op1_decontaminate
from . import op02_pii, op04_secrets
from .op02_pii import op2_pii
from .op03_html import op3_html
from .op04_secrets import op4_secrets
from .op05_simhash import op5_simhash
from .op06_media import op6_media
from .op07_tokens import op7_tokens
from .op08_sentencepiece import op8_sentencepiece
from .op09_toxicity import op9_toxicity
from .op10_chat import op10_chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_pii, op3_html, op4_secrets, op5_simhash, op6_media, op7_tokens, op8_sentencepiece, op9_toxicity, op10_chat)
}
ORACLE_SQL: dict[str, str] = {"op2_pii": op02_pii.oracle_sql(), "op4_secrets": op04_secrets.oracle_sql()}

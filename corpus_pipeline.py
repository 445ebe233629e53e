"""A training corpus from raw documents, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; the driver of the
stages writes each result as Parquet and hands it to the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import op01_decontaminate, op02_pii, op05_simhash, op08_sentencepiece, op09_toxicity
from factloom.llm.common import load, shared_dir
from factloom.shipping import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored as one empty window, a long one by all its windows; repeated rows share their fate;
    without labels of both classes all stay; an empty table stays empty; all columns pass unchanged.
    """
    ship(spark)
    return op09_toxicity.keep_ordinary(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, once.

    Null, empty and blank texts are one group; null ids come last; of rows that repeat an id the one with the least hash of
    its text stays, of whole rows that repeat any one; an empty table stays empty; all columns pass unchanged.
    """
    ship(spark)
    return op05_simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as does everything if there is no item; repeated rows share their fate; an empty
    table stays empty; all columns pass unchanged.
    """
    ship(spark)
    return op01_decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; the number of characters follows the text.

    A null text becomes an empty one of 0 characters; all rows stay, each for itself; other columns pass unchanged.
    """
    clean = op02_pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document as SentencePiece ids: (doc_id, ids).

    Null and empty texts have no ids; null and repeated doc_ids stay, each for itself; an empty table stays empty.
    """
    import public_tokenizers

    ship(spark)
    return op08_sentencepiece.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
#: SQL can express neither the fitted classifier nor the fingerprints: the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

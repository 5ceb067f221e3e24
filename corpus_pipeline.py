"""Corpus pipeline: from raw documents to token ids, one operator of fleetpulse.llm per stage.

Each stage reads all rows that the one before kept. Stages but the last return the columns of
`documents`; n_chars follows the text. Null and empty texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import bpe, jaccard, langid, mixing, pii
from fleetpulse.llm.common import settled
from fleetpulse.llm.queries import table, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or without a letter) go; a null lang is filled.

    Where no row has a lang there is nothing to learn from: texts with letters stay, with a null lang.
    """
    model = langid.train(docs, F.lit(True))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = langid.predicted(docs, model, docs.columns, ("__lang_pred", "__share")).filter(F.col("__lang_pred") != langid.UNKNOWN)
    return named.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id."""
    return jaccard.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    clean = pii.redacted(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its share of all words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return bpe.tokens(docs, tokenizer_file(), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

# learned models, components and draws are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

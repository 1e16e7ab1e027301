"""Corpus preparation in stages, each written and read again as the next one's documents.

A stage takes the session, the documents that its predecessor kept, and the folder of the
tables. All but the last return the columns of documents; the last returns the tokens.

Null and empty texts, and texts without a letter, have no language and go in the first stage.
Very long texts are taken whole. Rows that repeat are judged alike; of rows that share id and
text one stays, and of near copies the one with the least id. Extra columns come along whatever
their names. An empty documents table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import common, decontam, langid, neardup, pii, sentencepiece_scan

#: No stage but decontamination and near-duplicates can be written in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; without a letter there is none."""
    models = langid.fit(langid.trainable(docs))
    return langid.accepted(docs, models)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return neardup.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain the benchmark."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars to match."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its text."""
    coded = sentencepiece_scan.encode(docs, sentencepiece_scan.Vocabulary.load())
    return coded.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs

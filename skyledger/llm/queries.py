"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, lmscore, neardup, pii, prefix_trie, quality, resampling, secrets, sentencepiece_scan, token_counts, toxicity
from .common import fold


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    models = langid.fit(langid.trainable(docs))
    return docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), langid.identify(docs, models).alias("p")).select("doc_id", "held_out", "p.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(docs, model).alias("p")).select("doc_id", "held_out", "p.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(_docs(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.digest(sentencepiece_scan.encode(_docs(spark, sf_dir), sentencepiece_scan.Vocabulary.load()))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    templates = licenses.Templates(licenses.frequencies(docs))
    return docs.select("doc_id", licenses.scan(docs, templates).alias("p")).select("doc_id", "p.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", secrets.scan(docs, model=secrets.fit(docs)).alias("p")).select("doc_id", "p.*")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    train = F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(False))
    out = lmscore.score(docs, lmscore.fit(docs.where(train)), new=docs.where(~train))
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), *out.columns[1:])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_docs(spark, sf_dir), token_counts.Tokenizer.load())


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL: dict[str, str] = {
    "op4_decontamination": decontam.SQL,
    "op5_minhash_neardup": neardup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_importance_resampling": resampling.SQL,
}

"""Quality rules: simple counts, then a hashed n-gram log-likelihood ratio of trusted to raw text.

Words and pairs of words are hashed to BUCKETS; the share of each bucket in trusted documents
and in the whole corpus gives its log-ratio. A document's score is the mean over its n-grams, and
every document is held against one threshold, a low quantile of the scores of all trusted documents.

Null and empty texts have no words and fail the base rules. Very long texts are taken whole; the
last word begins no pair. Rows are judged one by one, so repeated rows get equal results, and a
score that equals the threshold is kept; only the key and the text are read. Without trusted
documents, as with an empty table, all ratios are equal and only the base rules decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BUCKETS = 1 << 13
SMOOTH = 5.0
#: Beyond so many bytes of trusted keys nothing is broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _places(last: Column) -> Column:
    """0, 1, ... last; nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def base_counts(rows: DataFrame) -> DataFrame:
    """Add the base columns to rows with the columns text and words."""
    w = F.col("words")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.withColumn("_lines", lines)
    runs = F.transform(_places(F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    rows = rows.withColumn("_runs", F.sort_array(runs))
    r = F.col("_runs")
    hash_at = lambda k: F.get(r, k)["h"]
    again = F.filter(_places(F.size(r) - 1), lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
    rows = rows.withColumn("_again", F.transform(again, lambda k: F.get(r, k)["i"]))
    return rows.select(
        *[c for c in rows.columns if c not in ("_lines", "_runs", "_again")],
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOL)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_again", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
    )


def grams(low: Column) -> Column:
    """Buckets of the words and of the pairs of words; `low` is a column of lower-case words."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    firsts = F.slice(low, 1, F.greatest(F.size(low) - 1, F.lit(0)))  # the last word begins no pair
    return F.concat(F.transform(low, lambda x: bucket(F.xxhash64(x))), F.transform(firsts, lambda x, i: bucket(F.xxhash64(x, F.get(low, i + 1)))))


@dataclass(frozen=True)
class QualityModel:
    """The log-ratio of each of the BUCKETS, and the threshold."""

    ratios: tuple[float, ...]
    threshold: float

    def column(self) -> Column:
        """The ratios as a constant array."""
        return F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")


def _score(ratios: Column) -> Column:
    g = F.col("grams")
    return F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.size(g)).otherwise(0.0)


def trusted_ids(labels: DataFrame, key: str, quality: str) -> DataFrame:
    """All documents that are labelled good."""
    return labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", quantile: float = 0.002, slack: float = 0.02, broadcast_bytes: int = BROADCAST_BYTES) -> QualityModel:
    """The log-ratio of each bucket, and the threshold.

    The corpus and its trusted documents are counted whole. The threshold lies `slack` below the
    score that the share `quantile` of all trusted documents reach at most.
    """
    trusted = trusted_ids(labels, key, quality).withColumn("good", F.lit(1))
    held = trusted.agg(F.sum(F.octet_length(F.col("k").cast("string")) + 64)).first()[0] or 0
    trusted = F.broadcast(trusted) if held <= broadcast_bytes else trusted
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    lowered = lambda df: df.select("good", words(F.col("text")).alias("words")).withColumn("low", F.transform("words", lambda x: F.lower(x)))
    # the generator takes the expression itself: a filter on its column would repeat it for every word
    counts = lowered(rows.join(trusted, "k", "left")).select("good", F.explode(grams(F.col("low"))).alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.count("good").alias("t"))
    found = {r["b"]: (r["n"], r["t"]) for r in counts.collect()}  # BUCKETS rows at most
    all_n, all_t = (sum(x[i] for x in found.values()) for i in (0, 1))
    share = lambda x, total: math.log((x + SMOOTH) / (total + SMOOTH * BUCKETS))
    ratios = tuple(share(t, all_t) - share(n, all_n) if all_t else 0.0 for n, t in (found.get(b, (0, 0)) for b in range(BUCKETS)))
    model = QualityModel(ratios, -math.inf)
    scores = stored(lowered(rows.join(trusted, "k")).select(grams(F.col("low")).alias("grams")).select(_score(model.column()).alias("s"), F.monotonically_increasing_id().alias("i")), "scores")
    n = scores.count()
    if not n:
        return model
    low = numbered(scores, F.col("s"), F.col("i")).where(F.col("number") == max(math.ceil(quantile * n) - 1, 0)).first()["s"]
    discard(scores)
    return QualityModel(ratios, low - slack)


def judge(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base columns, base_failed, llr and kept of every document."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("words", words(F.col("text")))
    rows = base_counts(rows).withColumn("low", F.transform("words", lambda x: F.lower(x)))
    rows = rows.withColumn("grams", grams(F.col("low")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), _score(model.column()).alias("llr"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(model.threshold)))

"""Importance resampling of documents towards a target, by hashed words.

Words come from the tokenizers library: a Split by a pattern, which needs no training, over texts
with A-Z lowered, gives words with their places. Windows of places give the runs of 1 to `most`
words; each run falls into one of `buckets` by its CRC. Two histograms, of the raw documents and of
the target, give each bucket a gain, the floored thousandfold logarithm of its ratio of smoothed
shares; a document's weight is the floored mean of its runs' gains. Scores are weights plus Gumbel
noise drawn from the id, so the highest ones are a sample without replacement.

Texts are split once; buckets are kept in the shared folder for the second pass. Histograms are
counted in each task before they meet. Null and empty texts and such without words have no runs and
weight 0. Long texts are split whole, in runs cut between words, so that memory follows the run.
Ties of the score go to the lesser id; rows that repeat are documents of their own. A row without
id has no score, is never drawn and doesn't count for the share. Empty tables give an empty result,
and an empty target gives gains from smoothing alone. Other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import concat_structs, lower_ascii, slices, stored, struct_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, MOST = 10_000, 1
SEED = 2024
#: Documents of fewer words are not drawn; of the others so many percent are.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes that are split at a time, and words whose buckets are remembered.
RUN, REMEMBERED = 1 << 20, 1 << 17
FIELDS = [("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))]


@dataclass(frozen=True)
class Features:
    """Runs of 1 to `most` words in `buckets` buckets."""

    buckets: int = BUCKETS
    most: int = MOST


def runs(data: bytes, limit: int = RUN) -> Iterator[bytes]:
    """A text in pieces of about `limit` bytes, cut before ASCII characters that are in no word."""
    begin = 0
    while begin + limit < len(data):
        end = begin + limit
        while end < len(data) and (data[end] >= 128 or chr(data[end]).isalnum()):
            end += 1
        yield data[begin:end]
        begin = end
    yield data[begin:]


def words(data: bytes, split) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Pieces of a text with the places of their words in bytes, as the library gives them."""
    from tokenizers import PreTokenizedString

    for piece in runs(data):
        found = PreTokenizedString(piece.decode("utf-8", "replace"))
        split.pre_tokenize(found)
        yield piece, [place for _, place, _ in found.get_splits("original", "byte")]


class Hashed:
    """Buckets of the runs of a text."""

    def __init__(self, features: Features) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.features, self.known = features, {}
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def bucket(self, run: bytes) -> int:
        got = self.known.get(run)
        if got is None:
            got = zlib.crc32(run) % self.features.buckets
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(run) < 64:
                self.known[run] = got
        return got

    def of(self, data: bytes) -> tuple[int, list[int]]:
        """The number of words and the buckets of all runs."""
        n, out, bucket, most = 0, [], self.bucket, self.features.most
        carried: list[bytes] = []  # the last words of the piece before, for runs across the cut
        for piece, places in words(data, self.split):
            n += len(places)
            found = [piece[a:b] for a, b in places]
            out += map(bucket, found)
            if most > 1:
                both = carried + found
                for size in range(2, most + 1):
                    out += [bucket(b" ".join(both[i : i + size])) for i in range(max(0, len(carried) - size + 1), len(both) - size + 1)]
                carried = both[len(both) - most + 1 :]
        return n, out


def hashed(text: Column, features: Features) -> Column:
    """struct<n_words, buckets> of texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Hashed(features)
        for batch in batches:
            parts = []
            for piece in slices(batch.fill_null(""), 1 << 22):
                found = [own.of(x) for x in piece.cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *(len(b) for _, b in found)])
                flat = np.fromiter((x for _, b in found for x in b), np.int32, int(ends[-1]))
                parts.append(struct_of(FIELDS, [[n for n, _ in found], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]))
            yield concat_structs(parts, FIELDS)

    return F.arrow_udf(run, "n_words bigint, buckets array<int>")(lower_ascii(text.cast("string")))


def histogram(rows: DataFrame, features: Features) -> DataFrame:
    """bucket and n, over all runs: counted task by task, then summed. At most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(features.buckets, np.int64)
        for b in batches:
            n += np.bincount(b.column("buckets").flatten().to_numpy(), minlength=features.buckets)
        full = np.flatnonzero(n)
        yield pa.record_batch([pa.array(full, pa.int64()), pa.array(n[full])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """The gain of each bucket."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: ((target.get(b, 0) + 1) * all_raw) / ((raw.get(b, 0) + 1) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weight(buckets: Column, gain: np.ndarray) -> Column:
    """The floored mean of the gains; 0 where there is no run."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            ends = b.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[b.values.to_numpy()[ends[0] : ends[-1]]])])
            n = np.diff(ends)
            total = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            yield pa.array(np.where(n > 0, total // np.maximum(n, 1), 0), pa.int64())

    return F.arrow_udf(run, "bigint")(buckets)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, features: Features = Features(), seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with n_features, weight and score, and the rank of those that are drawn."""
    found = docs.select("doc_id", hashed(F.col("text"), features).alias("p")).select("doc_id", "p.*")
    rows = stored(found, "features")
    aim = target.select(hashed(F.col("text"), features).alias("p")).select("p.buckets")
    raw, wanted = ({r["bucket"]: r["n"] for r in histogram(x, features).collect()} for x in (rows, aim))
    gain = gains(raw, wanted, features.buckets)
    out = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    out = out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    ranked = numbered(out.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()), F.col("score").desc(), F.col("doc_id"), name="rank", first=1)
    drawn = ranked.count() * percent // 100
    rest = out.where((F.col("n_words") < least_words) | F.col("doc_id").isNull()).withColumn("rank", F.lit(None).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH w AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, doc_id, x, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS x FROM w) GROUP BY ALL),
b AS (SELECT x, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + 2 * octet_length(encode(x)), 2), lambda i: CAST('0x' || substr(hex(encode(x)), i, 2) AS BIGINT))),
  lambda c, v: list_reduce([xor(c, v), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 10000 AS bucket FROM (SELECT DISTINCT x FROM f)),
g AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM f JOIN b USING (x) GROUP BY bucket),
k AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM g) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM g) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM g),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN b USING (x) JOIN k USING (bucket) WHERE side = 0 GROUP BY doc_id),
v AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END ELSE 0 END AS weight FROM documents d LEFT JOIN m USING (doc_id)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)
"""

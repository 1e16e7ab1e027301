"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Both dictionaries share the segments that are frequent in all labelled text; before these, each
has the segments that its own class uses far more often. A text is cut at white space into
windows, each compressed with either dictionary. Where the toxic one gives fewer bytes, the
window is suspicious; a calibrated logistic curve turns the differences into a score.

Null and empty texts have no window and get the score of no difference at all. Rows are scored
one by one, so repeated rows get equal results; other columns are not read. Very long texts are cut
into windows whole; a score of exactly 0.5 counts as toxic. Labels of a document that repeats are
merged (toxic if any row says so). Without labels of both kinds, as with empty tables, all scores
are 0. The dictionaries are bounded: the shared part has COMMON_BYTES, and each class has its 400
most telling segments, ties in alphabetical order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import concat_structs, struct_of

WINDOW = 48
SEGMENT = (5, 12)
COMMON_BYTES = 6000
#: In front of every window and in both dictionaries, so that a block is never stored uncompressed.
LEAD = bytes(range(128, 250))
PARAMETERS = {"strategy": zstd.STRATEGY_LAZY, "min_match": 5, "search_log": 4, "window_log": 15, "hash_log": 16, "chain_log": 16}
FIELDS = [("score", pa.float64()), ("predicted", pa.int32()), ("windows", pa.int64()), ("bytes_saved", pa.int64())]
SCHEMA = "score double, predicted int, windows bigint, bytes_saved bigint"


def windows(text: str) -> list[bytes]:
    """Runs of whole words of WINDOW bytes at least, each word after one space."""
    out, run, size = [], [], 0
    for word in text.encode().lower().split():
        run.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(run))
            run, size = [], 0
    if run:
        out.append(b" " + b" ".join(run))
    return out


def _segments(text: str) -> set[bytes]:
    """A word with the space before it, and its beginnings."""
    out = set()
    for word in set(text.encode().lower().split()):
        word = b" " + word
        out.update(word[:k] for k in range(SEGMENT[0], min(len(word), SEGMENT[1]) + 1))
    return out


def _without_copies(texts: list[str]) -> list[str]:
    """Texts most of whose 4-word runs are new, so that a copied text counts once."""
    seen: set[str] = set()
    out = []
    for text in texts:
        words = text.lower().split()
        runs = {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}
        if not runs or len(runs - seen) > 0.6 * len(runs):
            out.append(text)
        seen |= runs
    return out


def distinctive(own: Counter, other: Counter, least: int, ratio: float = 8.0) -> list[bytes]:
    """Segments far more frequent in `own`: each root with its longest ending that is about as frequent."""
    good = {s: n for s, n in own.items() if n >= least and n + 0.5 > ratio * (other[s] + 0.5)}
    chosen: dict[bytes, tuple[bytes, int]] = {}
    for s, n in sorted(good.items(), key=lambda x: (len(x[0]), x[0])):
        root = next((s[:k] for k in range(SEGMENT[0], len(s)) if s[:k] in good), None)
        if root is None:
            chosen[s] = (s, n)
        elif root in chosen and n >= 0.6 * good[root]:
            chosen[root] = (s, n)
    return [s for s, _ in sorted(chosen.values(), key=lambda x: (-x[1], x[0]))]


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(5))
    scale: np.ndarray = field(default_factory=lambda: np.ones(5))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    known: bool = False

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        p = zstd.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **PARAMETERS)
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstd.ZstdCompressor(dict_data=d, compression_params=p))
        return out[0], out[1]

    def features(self, text: str, pair: tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]) -> np.ndarray:
        ordinary, toxic = pair
        d = np.array([len(ordinary.compress(LEAD + w)) - len(toxic.compress(LEAD + w)) for w in windows(text)] or [0], float)
        return np.array([np.maximum(d - 1, 0).sum(), d.max(), (d >= 2).sum(), d.sum() / len(d) ** 0.5, np.log(len(d)), d.sum(), len(d)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(x))
        z = np.c_[(x[:, :5] - self.mean) / self.scale, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries from three quarters of the texts, the score's curve from the others."""
    toxic, ordinary = _without_copies(toxic), _without_copies(ordinary)
    if not toxic or not ordinary:
        return ToxicityModel()
    cut = lambda x: x[: max(1, 3 * len(x) // 4)]
    one, zero = Counter(), Counter()
    for texts, into in ((cut(toxic), one), (cut(ordinary), zero)):
        for text in texts:
            into.update(_segments(text))
    least = max(3, len(toxic) // 120)
    roots = distinctive(one, zero, least)
    words = [s for s, n in sorted(one.items(), key=lambda x: (-x[1], x[0])) if n >= 3 and any(s.startswith(r) for r in roots) and s not in roots]
    body = b"".join(reversed((roots + words)[:400]))
    frequent = b"".join(s for s, _ in sorted(zero.items(), key=lambda x: (x[1] * len(x[0]), x[0]))[-6000:])
    common = frequent[-COMMON_BYTES:]
    front = frequent[: len(frequent) - COMMON_BYTES][-len(body) :] if body else b""
    model = ToxicityModel(body + common + LEAD, front.rjust(len(body), b"\n") + common + LEAD, known=True)
    rest = [(t, 1.0) for t in toxic[len(cut(toxic)) :] or toxic] + [(t, 0.0) for t in ordinary[len(cut(ordinary)) :] or ordinary]
    pair = model.compressors()
    x, y = np.array([model.features(t, pair)[:5] for t, _ in rest]), np.array([v for _, v in rest])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    share = np.where(y == 1, 0.3, 1.0)  # toxic texts are rarer than in the sample
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (share * (p - y)) + 0.1 * w)
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = 1600) -> ToxicityModel:
    """A model from about `max_docs` labelled documents of each kind, chosen by a hash of their key."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).alias("y"))
    marks = marks.withColumn("at", F.pmod(F.xxhash64("k"), F.lit(1 << 20)))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not {0, 1} <= sizes.keys():
        return ToxicityModel()
    below = F.when(F.col("y") == 1, min(1 << 20, (max_docs << 20) // sizes[1])).otherwise(min(1 << 20, (max_docs << 20) // sizes[0]))
    chosen = marks.where(F.col("at") < below)
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "k").orderBy("at", "k").select("text", "y").toPandas()
    return train(got.text[got.y == 1].tolist(), got.text[got.y == 0].tolist())


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """A column struct<score, predicted, windows, bytes_saved> for a text column of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = held.value.compressors() if held.value.known else None
        for batch in batches:
            x = np.array([held.value.features(t or "", pair) if pair else np.zeros(7) for t in batch.to_pylist()]).reshape(-1, 7)
            p = held.value.scores(x)
            yield concat_structs([struct_of(FIELDS, [p, (p >= 0.5).astype(np.int32), x[:, 6].astype(np.int64), x[:, 5].astype(np.int64)])], FIELDS)

    return F.arrow_udf(run, SCHEMA)(F.col(text).cast("string"))

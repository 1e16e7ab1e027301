"""Language identification with interpolated Kneser-Ney character models.

One model per language over 4-grams of characters (letters in lower case, anything else a
space). The models share sorted arrays of n-gram hashes, one array for each order, with a
column of log-probabilities for each language, so that a position costs one search for all
languages. A text gets the language with the lowest cross-entropy per character.

Null texts and texts without a letter get `und`, score 0 and a null cross-entropy. The empty
text is such a text. Very long texts are taken whole; of languages that are equally near the
first in alphabetical order is taken. Rows are scored one by one, so repeated rows get equal
results; other columns of the table are not read. An empty training table gives `und` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import concat_structs, fold, slices, struct_of

ORDER = 4
ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = 1 << 20
FIELDS = [("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())]
SCHEMA = "lang_pred string, score double, cross_entropy double, rejected boolean"
#: A text counts with this many characters at most when its score is made, lest all be 1.
SCORE_CHARS = 40.0


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space."""
    table = np.full(0x10000, 32, np.uint16)
    for c in range(0x10000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return table


_TABLE: list[np.ndarray] = []


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in one array, each text after three spaces; where each starts and ends."""
    if not _TABLE:
        _TABLE.append(_letters())
    gap = " " * (ORDER - 1)
    codes = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[0][np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        out[far] = [(c & 0xFFFF | 0x8000) if chr(c).isalpha() else 32 for c in codes[far].tolist()]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + ORDER - 1)
    return out, ends - lens, ends


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """For each place the `order` characters that end there, 16 bits each."""
    out = codes.astype(np.uint64)
    for k in range(1, order):
        out[k:] |= codes[:-k].astype(np.uint64) << np.uint64(16 * k)
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _One:
    """The counts of one language and its interpolated probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet = alphabet
        self.levels = {}
        for order in range(ORDER, 0, -1):
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, where = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(where, counts, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            self.levels[order] = (keys, counts.astype(float), discount, contexts, total, discount * kinds / np.maximum(total, 1))
            # a lower order counts the different characters before it
            keys, counts = np.unique(keys & _mask(order - 1), return_counts=True) if order > 1 else (keys, counts)

    def weight(self, order: int, contexts: np.ndarray) -> np.ndarray:
        _, _, _, known, _, rest = self.levels[order]
        at, hit = _find(known, contexts)
        return np.where(hit, rest[at], 1.0)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        if not order:
            return np.full(len(keys), 1.0 / self.alphabet)
        own, counts, discount, known, total, _ = self.levels[order]
        contexts = keys >> np.uint64(16)
        at, hit = _find(known, contexts)
        i, seen = _find(own, keys)
        top = np.where(hit & seen, np.maximum(counts[i] - discount, 0) / np.maximum(total[at], 1), 0.0)
        return top + self.weight(order, contexts) * self.probability(order - 1, keys & _mask(order - 1))


class LanguageModels:
    """Sorted hash arrays with a column for each language."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.limit = langs, np.full(len(langs), np.inf)
        alphabet = len(np.unique(np.concatenate([k & _mask(1) for k, _ in counts.values()]))) + 1 if counts else 1
        models = [_One(*counts[x], alphabet) for x in langs]
        self.keys, self.logp, self.backoff = {}, {}, {}
        for order in range(1, ORDER + 1) if models else ():
            keys = np.unique(np.concatenate([m.levels[order][0] for m in models]))
            hashes = keys * ODD
            by = np.argsort(hashes)
            keys = keys[by]
            self.keys[order] = hashes[by]
            self.logp[order] = np.log(np.stack([m.probability(order, keys) for m in models], 1)).astype(np.float32)
            if order < ORDER:
                self.backoff[order] = np.log(np.stack([m.weight(order + 1, keys) for m in models], 1)).astype(np.float32)
        if models:
            lone = np.array([m.weight(1, np.zeros(1, np.uint64))[0] for m in models]) / alphabet
            self.unknown = np.log(lone).astype(np.float32)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """For each place and language, with shorter contexts where the longest was never seen."""
        packed = grams(codes, ORDER)
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        rest = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            key = packed[rest] & _mask(order)
            at, hit = _find(self.keys[order], key * ODD)
            out[rest[hit]] += self.logp[order][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
            if order > 1:
                ctx, known = _find(self.keys[order - 1], (key[~hit] >> np.uint64(16)) * ODD)
                out[rest[known]] += self.backoff[order - 1][ctx[known]]
            else:
                out[rest] += self.unknown
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character by language, the letters, and the characters of each text."""
        codes, starts, ends = characters(texts)
        sums = np.zeros((len(codes) + 1, len(self.langs)))
        np.cumsum(self.log_probabilities(codes), 0, out=sums[1:], dtype=np.float64)
        letters = np.concatenate([[0], np.cumsum(codes != 32)])
        n = ends - starts
        return -(sums[ends] - sums[starts]) / np.maximum(n, 1)[:, None], letters[ends] - letters[starts], n

    def predict(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The best language (-1: none), its score, its cross-entropy, and whether that is out of range."""
        nats, letters, n = self.cross_entropies(texts)
        none = letters == 0
        best = nats.argmin(1)
        low = nats.min(1)
        share = np.exp(-(nats - low[:, None]) * np.minimum(n, SCORE_CHARS)[:, None])
        score = 1.0 / share.sum(1)
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, np.nan, low), none | (low > self.limit[best])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            run, size = [], 0
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for i, text in enumerate(own):
                run.append(text)
                size += len(text)
                if size > RUN or i + 1 == len(own):
                    codes, starts, ends = characters(run)
                    inside = np.zeros(len(codes) + 1, np.int8)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    keys, n = np.unique(grams(codes, ORDER)[np.cumsum(inside[:-1]) > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
                    run, size = [], 0


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_docs: int = 1000, margin: float = 1.3) -> LanguageModels:
    """Models from about `max_docs` documents of each language, chosen by a hash of their key.

    A fifth of that sample is held back: a text is rejected if its cross-entropy exceeds the
    highest one there, of documents in its language of 20 characters or more, times `margin`.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)).alias("at")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModels([], {})
    below = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, min(1 << 20, (max_docs << 20) // n)))])
    rows = rows.withColumn("below", below[F.col("lang")]).where("at < below")
    spare = F.col("at") % 5 == 0
    got = rows.where(~spare).select("lang", "text").mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for name, part in got.groupby("lang"):
        part = part.assign(gram=part.gram.to_numpy().view(np.uint64)).sort_values("gram")
        counts[name] = (part.gram.to_numpy(np.uint64), part.n.to_numpy(np.int64))
    models = LanguageModels(sorted(counts), counts)
    if not counts:
        return models
    held = docs.sparkSession.sparkContext.broadcast(models)

    def worst(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nats, letters, _ = held.value.cross_entropies(b.text.tolist())
            own = b.lang.map({x: i for i, x in enumerate(held.value.langs)})
            ok = (letters >= 20) & own.notna().to_numpy()
            yield pd.DataFrame({"lang": b.lang[ok], "nats": nats[np.flatnonzero(ok), own[ok].astype(int)]})

    for r in rows.where(spare).select("lang", "text").mapInPandas(worst, "lang string, nats double").groupBy("lang").agg(F.max("nats").alias("nats")).collect():
        models.limit[models.langs.index(r["lang"])] = r["nats"] * margin
    return models


def identify(docs: DataFrame, models: LanguageModels, text: str = "text") -> Column:
    """A column struct<lang_pred, score, cross_entropy, rejected> for a text column of docs."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in batches:
            parts = []
            for run in slices(batch.fill_null(""), RUN):
                best, score, nats, out = m.predict(run.to_pylist()) if m.langs else (np.full(len(run), -1), np.zeros(len(run)), np.full(len(run), np.nan), np.ones(len(run), bool))
                parts.append(struct_of(FIELDS, [["und" if i < 0 else m.langs[i] for i in best], score, pa.array(nats, mask=np.isnan(nats)), out]))
            yield concat_structs(parts, FIELDS)

    return F.arrow_udf(predict, SCHEMA)(F.col(text).cast("string"))


def accepted(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """The documents whose language the models accept, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing names are out of the way
    rows = docs.toDF(*names)
    rows = rows.withColumn("p", identify(rows, models, names[docs.columns.index(text)]))
    return rows.where("NOT p.rejected").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def trainable(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that may teach: those whose fold of three is not 1."""
    return docs.where(fold(F.col(key), 3) != 1)

"""Secrets: fixed forms, and strings that a dictionary-primed compressor finds new.

A candidate is a long run of letters, digits and `+/_=-` within NEAR characters of a sensitive
word, before or behind it. Its novelty is the number of bytes that it adds to the compressed text
around it, with a zstandard dictionary of usual code, of the corpus's most frequent lines of code
and of its names. What costs more than nearly all ordinary runs of the same shape is reported as
kind `novel`; that alone decides.

Ordinary runs are those of the corpus that stand near no sensitive word: words, names, numbers. A
shape is digits alone, letters alone (with `_` and `-`, at most four digits behind), or anything
else. The limit of a shape is the cost that fewer than one in ORDINARY of its runs reach, so where
any run of a shape is as new as a secret, as with bare numbers, none is reported. It is measured on
all different ordinary runs of the corpus, each once with the first of its surroundings in
alphabetical order; a name of the dictionary is measured with one that lacks it. It is COST at
least. Without runs of a shape the limit is COST, and for digits none is reported.

Null and empty texts have no spans, and an empty table has no names. Rows are judged one by one,
so repeated rows get equal results; other columns are not read. Very long texts are taken whole.
Names and lines of equal counts are taken in alphabetical order. Spans are in code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import concat_structs, discard, stored, struct_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|credential|auth|bearer|private.key|access.key|api.?key|signature", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "novel")
RUN = re.compile(r"[A-Za-z0-9+/_=-]*")
#: Characters between a candidate and a sensitive word; bytes a character that a new string costs at least.
NEAR, COST = 60, 0.75
#: At most so many names of the corpus, of 12 to 64 characters, and lines of code, of 12 to 100, make the dictionary.
NAMES, LINES = 2000, 300
#: Fewer than one in ORDINARY of the ordinary runs reach the limit. So many runs of a task are merged at once.
ORDINARY, MERGED = 500, 20_000
CODE_LINE = r"^(?=[^\n]{12,100}$)[^\n]*(?:[;{}<>=]|\(\))"
NAME = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9_-]{12,64}+(?![A-Za-z0-9+/_=-]))[A-Za-z]++(?:[_-][A-Za-z]++)*+[0-9]{0,4}+(?![A-Za-z0-9+/_=-])"
#: Usual code and identifiers, as plain text for the dictionary.
CODE = b"""
import from return class def function const let var public static final private protected string int bool true false null none
self this new delete update insert select where value values key keys name names index item items list array map dict object
get set put post request response header headers content type application json text html utf-8 http https localhost port host
user username password passwd secret token access_token refresh_token api_key apikey client_id client_secret authorization bearer
config configuration settings environment variable default example placeholder changeme your_api_key_here xxxxxxxx test testing
database connection string server service account region bucket endpoint version public_key private_key certificate signature
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 12345678901234567890
"""
FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, in order."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


DIGITS, LETTERS, MIXED = 0, 1, 2
SHAPES = [re.compile(r"[0-9+/_=-]+"), re.compile(r"[A-Za-z]+(?:[_-]+[A-Za-z]+)*[0-9]{0,4}")]


def shape(run: str) -> int:
    """Digits alone, letters like a word or name, or mixed."""
    return next((k for k, p in enumerate(SHAPES) if p.fullmatch(run)), MIXED)


@dataclass(frozen=True)
class Model:
    """Names and lines for the dictionary, the most frequent ones first, and for each shape the cost at which a string is new."""

    names: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    limits: tuple[float, float, float] = (math.inf, COST, COST)


class Novelty:
    """Compressed bytes that a string adds to what stands around it."""

    def __init__(self, model: Model = Model()):
        p = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY, min_match=4, search_log=5, window_log=18, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
        own = "\n".join(reversed(model.lines)) + "\n" + " ".join(reversed(model.names))
        d = zstd.ZstdCompressionDict(own.encode() + CODE, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        self.compressor = zstd.ZstdCompressor(dict_data=d, compression_params=p)

    def cost(self, text: str, start: int, end: int) -> float:
        """Bytes a character that text[start:end] adds."""
        lead = CODE[:200] + (text[end : end + 100] + "\n" + text[max(0, start - 200) : start]).encode()
        more = len(self.compressor.compress(lead + text[start:end].encode())) - len(self.compressor.compress(lead))
        return more / (end - start)


def _frequent(found: Column, docs: DataFrame, most: int, least: int) -> list[str]:
    """The most frequent strings that occur `least` times."""
    each = docs.select(F.explode(found).alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r["x"] for r in each.orderBy(F.desc("n"), "x").limit(most).collect()]


def _ordinary(docs: DataFrame, text: str) -> DataFrame:
    """All different runs that stand near no sensitive word, with the first text around each and the run's place in it."""

    def rows(found: dict[str, tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x for x, _ in found.values()], pa.string()), pa.array([x for _, x in found.values()], pa.int32())], names=["run", "around", "at"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[str, int]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for m in CANDIDATE.finditer(t or ""):
                    around = t[max(0, m.start() - 200) : m.end() + 200]
                    at = min(m.start(), 200)
                    if not SENSITIVE.search(around[max(0, at - 80) : at + len(m[0]) + 80]):
                        found[m[0]] = min(found.get(m[0], (around, at)), (around, at))
                        if len(found) >= MERGED:
                            yield rows(found)
                            found = {}
        yield rows(found)

    picked = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pick, "run string, around string, at int")
    return picked.groupBy("run").agg(F.min(F.struct("around", "at")).alias("one")).select("run", "one.around", "one.at")


def _costs(runs: DataFrame, model: Model) -> DataFrame:
    """Shape and cost of each run, as if its own name were not in the dictionary."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty, own = Novelty(model), set(model.names)
        for batch in batches:
            shapes, costs = [], []
            for run, around, at in zip(*[batch.column(c).to_pylist() for c in ("run", "around", "at")], strict=True):
                by = Novelty(Model(tuple(x for x in model.names if x != run), model.lines)) if run in own else novelty
                shapes.append(shape(run))
                costs.append(by.cost(around, at, at + len(run)))
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.int32()), pa.array(costs, pa.float64())], names=["shape", "cost"])

    return runs.mapInArrow(measure, "shape int, cost double")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The corpus's most frequent names and lines of code, and what all its ordinary runs cost."""
    own = F.col(text).cast("string")
    names = _frequent(F.regexp_extract_all(own, F.lit(NAME), F.lit(0)), docs, NAMES, 1)
    lines = _frequent(F.filter(F.split(own, "\n"), lambda x: x.rlike(CODE_LINE)), docs, LINES, 3)
    model = Model(tuple(names), tuple(lines))
    # equal costs are told apart by a number, so that they are dealt out too
    costs = stored(_costs(_ordinary(docs, text), model).withColumn("i", F.monotonically_increasing_id()), "costs")
    sizes = {r["shape"]: r["n"] for r in costs.groupBy("shape").agg(F.count("*").alias("n")).collect()}
    limits = [math.inf if k == DIGITS else COST for k in range(3)]
    if sizes:
        before = {k: sum(n for x, n in sizes.items() if x < k) for k in sizes}
        ranks = [before[k] + n // ORDINARY for k, n in sizes.items()]
        # the dearest runs of a shape come first
        for r in numbered(costs, F.col("shape"), F.col("cost").desc(), F.col("i")).where(F.col("number").isin(ranks)).collect():
            limits[r["shape"]] = max(COST, math.nextafter(r["cost"], math.inf))
    discard(costs)
    return Model(model.names, model.lines, tuple(limits))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Long runs near sensitive words, in order; a run that a sensitive word is part of counts beside that word."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    done = 0
    for i in range(len(words) + 1 if words else 0):
        # the gap between two sensitive words, and the places in it that are near to one of them
        left = words[i - 1][1] if i else 0
        right = words[i][0] if i < len(words) else len(text)
        near = [(left, min(left + NEAR + 1, right))] if i else []
        if i < len(words):
            near.append((max(right - NEAR, left), right))
        for lo, hi in near:
            while lo > max(done, left) and RUN.fullmatch(text, lo - 1, lo):
                lo -= 1  # the run began before
            at = max(lo, done)
            while m := CANDIDATE.search(text, at, min(right, hi + 11)):
                if m.start() >= hi:
                    break
                end = RUN.match(text, m.start(), right).end()
                yield m.start(), end
                done = at = end


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, limits: tuple[float, ...] = Model.limits) -> list[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context that overlap no base span."""
    starts = [a for a, _, _ in base]
    ends = [0]
    for _, _, e in base:
        ends.append(max(ends[-1], e))
    out = []
    for a, e in candidates(text):
        limit = limits[shape(text[a:e])]
        if limit < math.inf and ends[bisect_left(starts, e)] <= a and novelty.cost(text, a, e) >= limit:
            out.append((a, 3, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(spans))


def judge(text: str | None, novelty: Novelty, limits: tuple[float, ...] = Model.limits) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    base = base_spans(text)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel_spans(text, base, novelty, limits))


def scan(docs: DataFrame, text: str = "text", model: Model = Model()) -> Column:
    """A column of the struct in SCHEMA for a text column of docs."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(model)
        for batch in batches:
            rows = [judge(t, novelty, model.limits) for t in batch.to_pylist()]
            yield concat_structs([struct_of(FIELDS, list(zip(*rows, strict=True)))] if rows else [], FIELDS)

    return F.arrow_udf(run, SCHEMA)(F.col(text).cast("string"))

"""Personal data: fixed forms, and candidates that boosted trees accept.

Generators propose spans with loose patterns. Small trees judge their format and what stands
before them. They are taught by the corpus's own fixed forms, each written another way in its own
surroundings (a card in groups of four with points, an address with (at) and (dot), a phone
number without its country), against all candidates of the corpus that overlap no fixed form.
Features are small whole numbers (kind of separators, Luhn's check, digits, context and so on), so
the corpus falls into a few hundred cells, whose counts are all that the fit needs. A threshold
for each generator is set on a quarter of the texts that the trees were not taught from: PRECISION
of each cell that it accepts there must have been taught as true. All other candidates of the corpus count as
false, bare numbers among them, though a few are personal data. Accepted spans get the kind `other`.

Null and empty texts have no spans, and an empty table gives a model that accepts nothing. Rows
are judged one by one, so repeated rows get equal results; only the key and the text are read.
Very long texts are taken whole. Spans are in code points, end exclusive; of spans that start
together the order is that of KINDS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "other"]
# Runs are possessive and start where a run starts, so that no text takes quadratic time; what
# they find is what the plain patterns find.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"(?<![0-9A-Za-z+.])\(?+[0-9](?:[ ().-]{0,2}+[0-9]){6,}+",
    "plus": r"\+[0-9](?:[ ().-]{0,2}+[0-9]){5,}+",
    "at": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,}+",
}
#: The part of the `at` generator's form that has neither @ nor brackets round the at.
SPOKEN = r" at [A-Za-z0-9-]++(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z]"
CONTEXT = r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|card|visa|account|iban|mail|contact|reach|ssn|\bip\b|address|token"
FEATURES = ["g", "digits", "separators", "context", "before", "groups", "luhn"]
BLOCK = 64
#: The part of each cell that a threshold accepts, on the texts held out, that was taught as true.
PRECISION = 0.9
# At most 255: zeros before the first other digit, or zeros alone; one way to match each part.
BYTE_PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"


def _spans(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each pattern a column array<struct<start, end, value>> of its matches in `text`.

    A match starts behind all that was split off and matched before it. Sums over blocks of
    matches give these places without a sum over everything for each match.
    """
    empty = F.array().cast("array<struct<gap:int,size:int,value:string>>")
    cut = {}
    for name, (pattern, gate) in patterns.items():
        parts = F.zip_with(F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size"), m.alias("value")))
        cut[name] = F.when(gate, F.filter(parts, lambda e: e["value"].isNotNull())).otherwise(empty)
    rows = rows.withColumns(cut)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, e: s + e["gap"] + e["size"])
    sums = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda j: total(F.slice(n, j * BLOCK + 1, BLOCK)))
    rows = rows.withColumns({f"{n}_s": F.when(F.size(n) > 0, sums(n)) for n in patterns})
    before = lambda n: F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda j: F.aggregate(F.slice(n, 1, j), F.lit(0), lambda s, x: s + x))
    rows = rows.withColumns({f"{n}_b": F.when(F.size(f"{n}_s") > 0, before(f"{n}_s")) for n in patterns})

    def placed(n: str) -> Column:
        def one(e: Column, i: Column) -> Column:
            j = F.floor(i / BLOCK).cast("int")
            start = F.get(f"{n}_b", j) + total(F.slice(n, j * BLOCK + 1, i % BLOCK)) + e["gap"]
            return F.struct(start.alias("start"), (start + e["size"]).alias("end"), e["value"].alias("value"))

        return F.when(F.size(f"{n}_b") > 0, F.transform(n, one)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    keep = [c for c in rows.columns if c not in patterns and c not in {f"{n}{x}" for n in patterns for x in ("_s", "_b")}]
    return rows.select(*keep, *[placed(n).alias(n) for n in patterns])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, text, and `base`: array<struct<start, kind, end>> of the fixed forms, in order."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    at, digit = F.col("text").contains("@"), F.col("has_digit")
    gates = {"email": at, "ip": digit, "card": digit, "phone": digit & F.col("text").contains("+")}
    rows = _spans(rows, {k: (BASE[k], gates[k]) for k in BASE})

    def valid(i: int, kind: str) -> Column:
        kept = F.filter(kind, lambda m: _valid(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))

    own = [valid(i, k) for i, k in enumerate(BASE)]
    return rows.select("key", "text", "has_digit", F.sort_array(F.concat(*own)).alias("base"))


def with_candidates(rows: DataFrame) -> DataFrame:
    """Add `found`: the generators' spans with their features and whether they overlap a fixed form."""
    text = F.col("text")
    at = text.contains("@") | text.contains("(at)") | text.contains("[at]") | text.rlike(SPOKEN)
    gates = {"number": F.col("has_digit"), "plus": F.col("has_digit") & text.contains("+"), "at": at}
    rows = _spans(rows, {k: (GENERATORS[k], gates[k]) for k in GENERATORS})

    def features(g: int):
        def one(m: Column) -> Column:
            digits = F.length(_digits(m["value"]))
            marks = F.regexp_replace(m["value"], "[^ ().-]", "")
            separators = F.when(marks == "", 0).when(marks.rlike(r"^\.+$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike("^ +$"), 3).when(marks.rlike(r"[()]"), 4).otherwise(5)
            lead = F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
            last = F.substring(text, m["start"], F.lit(1))
            bins = F.when(digits < 8, 0).when(digits < 10, 1).when(digits < 12, 2).when(digits < 14, 3).when(digits < 17, 4).otherwise(5)
            groups = F.size(F.split(m["value"], "[^0-9A-Za-z]+"))
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.lit(g).alias("g"),
                bins.alias("digits"),
                separators.alias("separators"),
                F.when(m["start"] > 0, lead.rlike(CONTEXT).cast("int")).otherwise(0).alias("context"),
                F.when(m["start"] == 0, 0).when(last.rlike(r"\s"), 1).otherwise(2).alias("before"),
                F.when(groups <= 1, 0).when(groups <= 3, 1).when(groups <= 4, 2).otherwise(3).alias("groups"),
                F.when(digits.between(14, 19), _luhn(_digits(m["value"])).cast("int")).otherwise(0).alias("luhn"),
                F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])).alias("known"),
            )

        return one

    return rows.select("key", "text", "base", F.concat(*[F.transform(k, features(g)) for g, k in enumerate(GENERATORS)]).alias("found"))


@dataclass(frozen=True)
class Boosted:
    """Trees of three questions and four leaves, and a threshold for each generator."""

    bias: float
    trees: tuple[tuple, ...]
    thresholds: tuple[float, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for (f, t), (f0, t0), (f1, t1), leaf in self.trees:
            out += np.where(x[:, f] <= t, np.where(x[:, f0] <= t0, leaf[0], leaf[1]), np.where(x[:, f1] <= t1, leaf[2], leaf[3]))
        return out

    def column(self, span: Column) -> Column:
        at = lambda f: span[FEATURES[f]]
        total = F.lit(self.bias)
        for (f, t), (f0, t0), (f1, t1), leaf in self.trees:
            total = total + F.when(at(f) <= t, F.when(at(f0) <= t0, leaf[0]).otherwise(leaf[1])).otherwise(F.when(at(f1) <= t1, leaf[2]).otherwise(leaf[3]))
        return 1 / (1 + F.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[tuple[int, int], float]:
    best, gain = (0, int(x[:, 0].max(initial=0))), -np.inf
    for f in range(x.shape[1]):
        for t in np.unique(x[rows, f])[:-1]:
            low = rows & (x[:, f] <= t)
            high = rows & ~low
            value = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
            if value > gain:
                best, gain = (f, int(t)), value
    return best, gain


def boost(x: np.ndarray, n: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 25, rate: float = 0.4, precision: float = PRECISION) -> Boosted:
    """Boosted trees on cells: features x, counts n, true ones among them y; held has n and y for the thresholds."""
    if not len(x):
        return Boosted(0.0, (), (2.0,) * len(GENERATORS))
    n, y = n.astype(float), y.astype(float)
    share = (y.sum() + 0.5) / (n.sum() + 1)
    model = Boosted(float(np.log(share / (1 - share))), (), ())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.raw(x)))
        g, h = y - n * p, n * p * (1 - p)
        everything = np.ones(len(x), bool)
        root, _ = _split(x, g, h, everything)
        low = x[:, root[0]] <= root[1]
        sides = [_split(x, g, h, side)[0] for side in (low, ~low)]
        leaf = []
        for side, (f, t) in zip((low, ~low), sides, strict=True):
            for part in (side & (x[:, f] <= t), side & (x[:, f] > t)):
                leaf.append(float(np.clip(rate * g[part].sum() / (h[part].sum() + 1), -3, 3)))
        model = Boosted(model.bias, (*model.trees, (root, *sides, tuple(leaf))), ())
    p = 1 / (1 + np.exp(-model.raw(x)))
    n, y = (n, y) if held is None else held
    limits = []
    for k in range(len(GENERATORS)):
        own, limit = x[:, 0] == k, 2.0
        for t in sorted(set(p[own]), reverse=True):
            at = own & (p == t)  # each cell by itself, or many sure ones would carry doubtful ones
            if not n[at].sum():
                continue
            if y[at].sum() < precision * n[at].sum():
                break
            limit = float(t) - 1e-9
        limits.append(limit)
    return Boosted(model.bias, model.trees, tuple(limits))


def taught(rows: DataFrame) -> DataFrame:
    """The rows of base_spans, and for each fixed form a short one that has it written another way.

    The key tells which is which (`again`) and the fold of the text (`held`).
    """
    text = F.col("text")

    def other(kind: Column, value: Column) -> Column:
        email = F.regexp_replace(F.regexp_replace(value, "@", " (at) "), r"\.", " (dot) ")
        card = F.regexp_replace(_digits(value), "([0-9]{4})(?=[0-9])", "$1.")
        phone = F.nullif(F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-](?=[(0-9])", ""), value)  # null: nothing parts the country
        return F.when(kind == 0, email).when(kind == 2, card).when(kind == 3, phone)

    def short(b: Column) -> Column:
        lead = F.substring(text, F.greatest(b["start"] - 23, F.lit(1)), F.least(b["start"], F.lit(24)))
        return F.struct(lead.alias("lead"), other(b["kind"], F.substring(text, b["start"] + 1, b["end"] - b["start"])).alias("value"), b["kind"].alias("kind"))

    def row(s: Column) -> Column:
        start = F.char_length(s["lead"])
        span = F.struct(start.alias("start"), s["kind"].alias("kind"), (start + F.char_length(s["value"])).alias("end"))
        return F.struct(F.lit(True).alias("again"), F.concat(s["lead"], s["value"]).alias("text"), F.array(span).alias("base"))

    whole = F.array(F.struct(F.lit(False).alias("again"), text.alias("text"), F.col("base").alias("base")))
    more = F.transform(F.filter(F.transform("base", short), lambda s: s["value"].isNotNull()), row)
    held = (F.crc32(text) % 4 == 0).alias("held")
    out = rows.select(held, F.explode(F.concat(whole, more)).alias("r"))
    return out.select(F.struct("held", "r.again").alias("key"), "r.text", "r.base").withColumn("has_digit", F.col("text").rlike("[0-9]"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Boosted:
    """The trees, from all candidates of all documents."""
    radix = 10  # more than any feature's values

    def cell(s: Column) -> Column:
        code = F.col("key.held").cast("int") * radix + s["known"].cast("int")
        for f in FEATURES:
            code = code * radix + s[f]
        return code

    # one number a span: exploded structs would have each field computed on its own
    found = F.filter("found", lambda s: s["known"] == F.col("key.again"))
    codes = with_candidates(taught(base_spans(docs, key, text))).select(F.explode(F.transform(found, cell)).alias("code"))
    cells: dict[tuple[int, ...], np.ndarray] = {}
    for r in codes.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect():  # 2 * 2 * 3 * 6 * 6 * 2 * 3 * 4 * 2 rows at most
        held, known, *digits = (r["code"] // radix**k % radix for k in reversed(range(len(FEATURES) + 2)))
        cells.setdefault(tuple(digits), np.zeros((2, 2)))[held] += (r["n"], r["n"] * known)
    x = np.array(sorted(cells)).reshape(-1, len(FEATURES))
    counts = np.array([cells[c] for c in sorted(cells)]).reshape(-1, 2, 2)
    return boost(x, counts[:, 0, 0], counts[:, 0, 1], (counts[:, 1, 0], counts[:, 1, 1]))


def find(docs: DataFrame, model: Boosted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, text, base and `spans`: all spans as array<struct<start, kind, end>>, in order."""
    rows = with_candidates(base_spans(docs, key, text))
    limit = lambda s: F.get(F.array(*[F.lit(x) for x in model.thresholds]), s["g"])
    new = F.filter("found", lambda s: ~s["known"] & (model.column(s) >= limit(s)))
    more = F.transform(new, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), s["end"].alias("end")))
    return rows.select("key", "text", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of a report on found spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("key").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns stay."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).alias("own"))
    rows = find(packed, model, "row", "own")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col("text")

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        put = F.concat(a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(put).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.char_length(body))))
    new = F.when(F.size("spans") == 0, F.col("key")[text]).otherwise(done)
    rows = rows.withColumn("new", new)
    return rows.select(*[F.col("new").alias(c) if c == text else F.col("key")[c].alias(c) for c in docs.columns])

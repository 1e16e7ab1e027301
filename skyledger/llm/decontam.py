"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of an item (all words of a shorter item). Hash every 5 words;
of each 9 neighbouring hashes, which span 13 words, keep the least. A span of 13 words or more
that a document shares with an item therefore has a kept hash in common with it. Kept hashes of
documents meet those of the items; each hit is extended to its windows, which are compared in
full. Items of fewer words than a window are fingerprinted by all their words at once. A document
is cut into blocks of BLOCK windows beforehand, each with the words that its windows reach; since
a window's kept hash depends on its own words alone, the cuts change nothing, and no row carries,
and no hit looks through, more than a block.

Null and empty texts have no words. Rows that share key and text are judged once and come back
as often as they were; null keys are a value like any other. Only key and text are read. An empty
benchmark gives no hits, an empty documents table no rows. An item that repeats counts once. Very
long texts are taken whole. Of hashes that tie within a window either is the same fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Windows that begin in one block of a document.
BLOCK = 512
#: Beyond so many bytes of items' windows nothing is broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _places(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _run(w: Column, at: Column, n: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(w, at, n))


def with_signatures(rows: DataFrame) -> DataFrame:
    """Add `sig`, the kept hash of every 13-word window of `words`."""
    w = F.col("words")
    hashes = F.transform(_places(F.size(w) - GRAM + 1), lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(GRAM)]))
    rows = rows.withColumn("_h", hashes)
    return rows.withColumn("sig", F.transform(_places(F.size("_h") - WINDOW + 1), lambda i: F.array_min(F.slice("_h", i, WINDOW)))).drop("_h")


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, length, window, fingerprint) of the items."""
    rows = with_signatures(benchmark.select(F.col(key).alias("item"), words(F.col(text)).alias("words"))).where(F.size("words") > 0)
    m = F.least(F.size("words"), F.lit(SPAN))
    rows = rows.withColumn("m", m).withColumn("at", F.explode(_places(F.size("words") - F.col("m") + 1)))
    window = _run(F.col("words"), F.col("at"), F.col("m"))
    return rows.select("item", "m", window.alias("win"), F.when(F.col("m") == SPAN, F.get("sig", F.col("at") - 1)).otherwise(F.xxhash64(window)).alias("fp")).distinct()


def _fingerprints(lengths: list[int]) -> Column:
    """Kept hashes of a block, and those of its shorter windows if items are that short."""
    w = F.col("words")
    parts = [F.transform(F.array_distinct("sig"), lambda h: F.struct(F.lit(SPAN).alias("m"), h.alias("fp")))]

    def short(n: int) -> Column:
        own = F.array_distinct(F.transform(_places(F.least(F.size(w) - n + 1, F.lit(BLOCK))), lambda i: F.xxhash64(_run(w, i, n))))
        return F.transform(own, lambda h: F.struct(F.lit(n).alias("m"), h.alias("fp")))

    return F.concat(*parts, *[short(n) for n in lengths])


def _extended() -> Column:
    """The places of a block's windows that have the fingerprint `fp`."""
    w, m = F.col("words"), F.col("m")
    long = F.filter(_places(F.size("sig")), lambda i: F.get("sig", i - 1) == F.col("fp"))
    short = F.filter(_places(F.least(F.size(w) - m + 1, F.lit(BLOCK))), lambda i: F.xxhash64(_run(w, i, m)) == F.col("fp"))
    return F.when(m == SPAN, long).otherwise(short)


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text hash, n_words, words before the block, its words and kept hashes; one block at least for each document."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("th"), words(F.col(text)).alias("all"))
    count = F.greatest(F.ceil(F.size("all") / BLOCK), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.struct((c * BLOCK).alias("before"), F.slice("all", c * BLOCK + 1, BLOCK + SPAN - 1).alias("words")))
    rows = rows.select("key", "th", F.size("all").cast("long").alias("n_words"), F.explode(cut).alias("b"))
    return with_signatures(rows.select("key", "th", "n_words", "b.before", "b.words"))


def _covered(places: Column) -> Column:
    """Words under windows (start, length), each once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(F.greatest(a["end"], p["at"] + p["m"]).alias("end"), (a["n"] + F.greatest(p["at"] + p["m"] - F.greatest(a["end"], p["at"]), F.lit(0))).alias("n"))
    return F.aggregate(F.sort_array(places), zero, step)["n"]


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Key, text hash, n_words, n_hit, items and contaminated of every document."""
    bench = stored(item_windows(benchmark, item), "windows")
    lengths = sorted(r["m"] for r in bench.select("m").distinct().collect() if r["m"] < SPAN)  # 12 at most
    prints = bench.select("m", "fp").distinct()
    pairs = bench.groupBy(F.col("m").alias("bm"), F.col("win").alias("bwin")).agg(F.sort_array(F.collect_set("item")).alias("its"))
    held = bench.agg(F.sum(F.octet_length("win") + F.octet_length(F.col("item").cast("string")) + 64)).first()[0] or 0
    small = held <= broadcast_bytes
    rows = _blocks(docs, key, text).withColumn("prints", _fingerprints(lengths))
    # in a document's first block a row without fingerprint stands for the document itself
    own = F.when(F.col("before") == 0, F.array(F.struct(F.lit(0).alias("m"), F.lit(0).cast("long").alias("fp")))).otherwise(F.array().cast("array<struct<m:int,fp:bigint>>"))
    each = rows.select("key", "th", "n_words", "before", "words", "sig", F.explode(F.concat(own, "prints")).alias("p"))
    each = each.select("key", "th", "n_words", "before", "words", "sig", "p.m", "p.fp")
    if small:
        marked = prints.withColumn("hit", F.lit(1))
        found = each.join(F.broadcast(marked), ["m", "fp"], "left").where("m = 0 OR hit = 1")
        found = found.withColumn("at", F.explode_outer(F.when(F.col("m") > 0, _extended())))
        met = found.select("key", "th", "n_words", F.expr("nullif(m, 0)").alias("length"), (F.col("before") + F.col("at")).alias("at"), F.when(F.col("at").isNotNull(), _run(F.col("words"), F.col("at"), F.col("m"))).alias("win"))
        met = met.withColumnRenamed("length", "m")
    else:
        # only keys and hashes meet; the blocks with hits are then read again
        hit = each.where("m > 0").select("key", "th", "before", "m", "fp").join(prints, ["m", "fp"], "left_semi").select(F.col("key").alias("k"), F.col("th").alias("t"), F.col("before").alias("b"), "m", "fp").distinct()
        found = _blocks(docs, key, text).join(hit, F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t")) & (F.col("before") == F.col("b"))).withColumn("at", F.explode(_extended()))
        found = found.select("key", "th", F.lit(None).cast("long").alias("n_words"), "m", (F.col("before") + F.col("at")).alias("at"), _run(F.col("words"), F.col("at"), F.col("m")).alias("win"))
        met = each.where("m = 0").select("key", "th", "n_words", F.lit(None).cast("int").alias("m"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("win")).unionByName(found)
    # a window brings its items as one list, so that a passage of many items is one row of a document
    met = met.join(F.broadcast(pairs) if small else pairs, (F.col("m") == F.col("bm")) & (F.col("win") == F.col("bwin")), "left")
    # the document's own row, and rows of windows that are really an item's
    met = met.where("m IS NULL OR bm IS NOT NULL")
    out = met.groupBy("key", "th").agg(
        F.count(F.when(F.col("m").isNull(), 1)).alias("times"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("m").isNotNull(), F.struct("at", "m"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("its"))).alias("items"),
    )
    out = out.select("key", "th", "n_words", _covered(F.col("places")).alias("n_hit"), "items", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return out.select("key", "th", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digest(judged: DataFrame) -> DataFrame:
    """The columns of a report on judged documents."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = judge(docs, benchmark, key, text, item).where("contaminated").select("key", "th").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing names are out of the way
    own = {c: F.col(names[docs.columns.index(c)]) for c in (key, text)}
    left = docs.toDF(*names).join(bad, own[key].eqNullSafe(F.col("key")) & (F.xxhash64(own[text].cast("string")) == F.col("th")), "left_anti")
    return left.toDF(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM bi),
ms AS (SELECT DISTINCT m FROM bw),
di AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM di),
h AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

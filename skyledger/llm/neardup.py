"""Near-duplicates by b-bit MinHash.

A document's set has its distinct runs of five words. Documents with equal sets fall together
first. Each distinct set then gets HASHES minima, of which only the low 16 bits are kept, packed
into one binary signature. Four neighbouring values form a band; sets that share a band are
candidates. Candidates pass if the bit count of their signatures, corrected for chance agreement,
is high enough, and are then confirmed on the full sets.

In each band one member is the centre (a different one in each family of bands), so that a group
of n copies gives about n pairs; confirmed pairs are joined into components. Bands whose members
still lie in different components are then searched by blocks, where all pairs of different
components meet. Most rows of a large band lie in one component and need no other row of it, so
the search grows with the rows that differ. A band of more than WIDE differing rows (a passage
that many texts share) is searched by prefixes instead: of two similar sets each has one of its
rarest quarter of shingles, in one order for all, in common with the other's. What the texts share
comes last in that order, so that unlike texts don't meet. The order needs only the counts of the
most frequent shingles, which are few; any order gives the same links.

A pair of similarity 0.75 shares no band with a probability of 5e-6, and fails the bit count with
1.2e-6 (fewer than 72 of 128 equal minima).

Null and empty texts, and texts without words, have empty sets and are linked with nothing. A
text of fewer than five words has one run of all its words. Texts are taken whole, however long;
very long ones fill blocks of their own. Each row is a document of its own: rows that repeat an
id and a text get equal results, rows that repeat an id with different texts are linked only by
what the texts share. A null id is never linked. Ties (several least ids) can't matter, since
equal ids are the same number. An empty table gives an empty one. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete, discard, stored

RUN_WORDS, HASHES, ROWS = 5, 128, 4
BANDS = HASHES // ROWS
FAMILIES = 2
#: Rows, and shingles, of a block of a band.
BLOCK, BLOCK_ITEMS = 512, 1 << 19
#: Rows of a band outside its largest component beyond which it is searched by prefixes.
WIDE = 8192
#: At most so many frequent shingles, each more than this share of all, are put in order by their counts.
FREQUENT = 100_000
#: Rows of equal sets are split so that no part has more than this share of all rows.
PARTS = 1000
CHUNK = 1 << 20
SIMILAR = 0.56
PLACE = ["band", "word", "i", "j"]
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = _RNG.integers(1, 1 << 63, (2, 1 << 12), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS[1][0] = 1  # a word's hash must not depend on how long others are
PIECE = 1 << 22


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff((~SPACE[data]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    value = BYTE_CODES[LOWER[data[np.repeat(starts, sizes) + place]]] * _POWERS[0][place & 4095]
    if sizes.max() > 4096:
        value *= _POWERS[1][(place >> 12) & 4095]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * MULTIPLIER), starts, ends


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a byte array, A-Z in lower case; long arrays in pieces of whole words."""
    parts, lo = [], 0
    while lo < len(data) or not parts:
        hi = min(lo + PIECE, len(data))
        while hi < len(data) and not SPACE[data[hi]]:  # to the end of the word
            hi += int(SPACE[data[hi : hi + 4096]].argmax()) or len(data[hi : hi + 4096])
        h, starts, ends = _hashed(data[lo:hi])
        parts.append((h, starts + lo, ends + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array; where each text's begin (and the end)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    words, starts, _ = word_hashes(data)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, begin)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - RUN_WORDS + 1, 1))
    out = np.zeros(int(count.sum()), np.uint64)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    for k in range(RUN_WORDS):
        there = at + k < first[owner + 1]
        w = np.where(there, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(0))
        out = mix(out * MULTIPLIER + w + np.uint64(k + 1))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    if len(out):
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The low 16 bits of HASHES minima of each set; zeros for an empty set."""
    n = len(bounds) - 1
    out = np.zeros((n, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for k in range(HASHES):
            low = np.minimum.reduceat(values * FACTORS[k] + OFFSETS[k], bounds[full])
            out[full, k] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    lo, size, run = 0, 0, []
    for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        if run and size + len(t or b"") > CHUNK:
            yield lo, run
            lo, size, run = i, 0, []
        run.append(t or b"")
        size += len(t or b"")
    if run:
        yield lo, run


def _described(batch: pa.RecordBatch, lo: int, run: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """The sets of a run of rows, where each begins, and id, th, n and the two sums that name a set."""
    values, bounds = shingles(run)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    keys = np.zeros((len(run), 2), np.uint64)
    if len(full):  # two sums of mixed hashes name a set, whatever its order
        keys[full, 0] = np.add.reduceat(mix(values ^ MULTIPLIER), bounds[full])
        keys[full, 1] = np.add.reduceat(mix(values + MULTIPLIER), bounds[full])
    columns = [batch.column("id").slice(lo, len(run)), batch.column("th").slice(lo, len(run)), pa.array(sizes.astype(np.int32)), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))]
    return values, bounds, pa.RecordBatch.from_arrays(columns, names=["id", "th", "n", "k1", "k2"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, run in _runs(batch):
            values, bounds, out = _described(batch, lo, run)
            yield out.append_column("sig", pa.array([x.tobytes() for x in signatures(values, bounds)], pa.binary()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, run in _runs(batch):
            values, bounds, out = _described(batch, lo, run)
            yield out.append_column("items", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64))))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of edges (a, b): comp is the least id that can be reached.

    Large and small stars in turn: every vertex passes its least neighbour to the others, until
    nothing changes. Edges and least neighbours are written to the shared folder; their joins are
    then plain ones, of which Spark splits a hub's rows over several tasks.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        new = stored(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        discard(now, least, large, low)
        now, after = new, total(new)
        if after == before:
            break
        before = after
    ends = now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(ends)


def lanes(column: pa.BinaryArray) -> np.ndarray:
    """Packed signatures as rows of 16-bit values."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(-1, HASHES)


def similarity(equal: np.ndarray) -> np.ndarray:
    """The share of equal minima, with agreement of 16 bits by chance taken off."""
    return (equal / HASHES - 2.0**-16) / (1 - 2.0**-16)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures are similar enough."""
    for batch in batches:
        if batch.num_rows:
            equal = (lanes(batch.column("sa")) == lanes(batch.column("sb"))).sum(1)
            yield batch.select(["a", "b", "salt"]).filter(pa.array(similarity(equal) >= SIMILAR))


def _search(percent: int, exact: bool):
    """Pairs of different components within the blocks of bands, by bit counts of their signatures.

    Without `exact` the rows that take part in a likely pair are passed on. With it the pairs'
    sets are at hand and compared in full, and only links come out; of components that the block
    has already linked no further pair is needed.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in complete(batches, PLACE):
            cid, comp, side, band, size = (batch.column(c).to_numpy() for c in ("cid", "comp", "side", "band", "n"))
            sig = lanes(batch.column("sig"))
            words = sig.view(np.uint64)
            if exact:
                ends, items = batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy().view(np.uint64)
            keep, links = np.zeros(batch.num_rows, bool), []
            for lo, hi in zip(starts, starts[1:], strict=False):
                group: dict[int, int] = {}

                def root(c, group=group):
                    while c in group:
                        c = group[c]
                    return c

                within = side[lo] == 2
                left = np.arange(lo, hi) if within else lo + np.flatnonzero(side[lo:hi] == 0)
                right = left if within else lo + np.flatnonzero(side[lo:hi] == 1)
                for k, i in enumerate(left):
                    at = right[k + 1 :] if within else right
                    at = at[(comp[at] != comp[i]) & (100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i]))]
                    if not len(at):
                        continue
                    # a pair of a band is met once, in the first band that it shares
                    at = at[(similarity((sig[at] == sig[i]).sum(1)) >= SIMILAR) & ((band[i] == BANDS) | ((words[at] == words[i]).argmax(1) == band[i]))]
                    if not exact:
                        keep[at] = True
                        keep[i] |= len(at) > 0
                        continue
                    own = items[ends[i] : ends[i + 1]]
                    for j in at:
                        one, two = root(comp[i]), root(comp[j])
                        if one == two:
                            continue
                        other = items[ends[j] : ends[j + 1]]
                        common = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                        if 100 * common >= percent * (len(own) + len(other) - common):
                            group[one] = two
                            links.append((cid[i], cid[j]))
            if exact:
                pairs = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            else:
                yield batch.select([*PLACE, "side", "cid", "comp", "n"]).filter(pa.array(keep))

    return search


def _prefixes(percent: int, frequent: np.ndarray, counts: np.ndarray):
    """The shingles of each set by which it meets similar ones: the rarest, then by hash."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, ends, items = batch.column("cid").to_numpy(), batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy()
            out = []
            for lo, hi in zip(ends, ends[1:], strict=False):
                own = items[lo:hi]
                at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
                count = np.where(frequent[at] == own, counts[at], 0) if len(frequent) else np.zeros(len(own), np.int64)
                out.append(own[np.lexsort((own, count))][: len(own) - -(-percent * len(own) // 100) + 1])
            sizes = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid, sizes)), pa.array(np.repeat(np.diff(ends).astype(np.int32), sizes)), pa.array(np.concatenate(out))], names=["cid", "n", "word"])

    return prefixes


def _prefix_bands(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A band for each shingle in the prefix of some member; its number is BANDS."""
    own = stored(sets.join(members, "cid", "left_semi"), "members")
    total = own.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    found = own.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") * FREQUENT > total)
    top = found.orderBy("item").toPandas()  # fewer than FREQUENT rows, since the counts sum to the total
    order = _prefixes(percent, top["item"].to_numpy(np.int64), top["count"].to_numpy(np.int64))
    bands = stored(own.select("cid", "items").mapInArrow(order, "cid bigint, n int, word bigint").select(F.lit(BANDS).alias("band"), "word", "cid", "n"), "prefixes")
    discard(own)
    return bands


def _blocks(bands: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, split: bool = True) -> DataFrame:
    """Rows of bands that have several components, with the blocks in which they meet.

    The rows of a small band all meet in one block. In a larger one those of its largest component
    need not meet each other: each of them goes to one block, and only the other rows, which
    differ from it, are given to all blocks.
    """
    named = bands.join(comp, bands.cid == comp.id, "left").select("band", "word", "cid", "n", F.coalesce("comp", "cid").alias("comp"))
    open_ = named.groupBy("band", "word").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("all"), F.sum("n").alias("size")).where("lo <> hi")
    open_ = stored(open_.select("band", "word", "all", "size"), "open")
    rows = named.join(open_, ["band", "word"])
    big = rows.where((F.col("all") > BLOCK) | (F.col("size") > BLOCK_ITEMS))
    own = big.groupBy("band", "word", "comp").agg(F.count("*").alias("own"), F.sum("n").alias("own_size"))
    top = stored(own.groupBy("band", "word").agg(F.max(F.struct("own", "comp", "own_size")).alias("top"), F.sum("own").alias("rows")), "top")
    wide = top.where(F.col("rows") - F.col("top.own") > WIDE).select("band", "word")
    if split and wide.take(1):
        by_prefix = _prefix_bands(bands.join(wide, ["band", "word"], "left_semi").select("cid").distinct(), sets, percent)
        narrow = bands.join(wide, ["band", "word"], "left_anti")
        return _blocks(narrow, comp, sets, percent, False).unionByName(_blocks(by_prefix, comp, sets, percent, False))
    rows = rows.join(top.drop("rows"), ["band", "word"], "left")
    parts = lambda count, size: F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_ITEMS), F.lit(1)).cast("int")
    first, rest = parts(F.coalesce("top.own", F.lit(0)), F.coalesce("top.own_size", F.lit(0))), parts(F.col("all") - F.coalesce("top.own", F.lit(0)), F.col("size") - F.coalesce("top.own_size", F.lit(0)))
    rows = rows.withColumns({"first": first, "rest": rest, "inside": F.coalesce(F.col("comp") == F.col("top.comp"), F.lit(False))})
    at = F.pmod(F.xxhash64("cid"), F.when(F.col("inside"), F.col("first")).otherwise(F.col("rest"))).cast("int")
    rows = rows.withColumn("at", at)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    # block pairs (i, j) with i <= j; side 0: the row is of i, 1: of j, 2: of both
    others = F.transform(numbers(F.col("rest")), lambda j: place(F.least("at", j), F.greatest("at", j), F.when(F.col("at") == j, 2).when(F.col("at") < j, 0).otherwise(1)))
    firsts = F.when(F.col("top").isNotNull(), F.transform(numbers(F.col("first")), lambda k: place(F.lit(-1), k, F.lit(1)))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    places = F.when(F.col("inside"), F.array(place(F.lit(-1), F.col("at"), F.lit(0)))).otherwise(F.concat(others, firsts))
    return rows.select("band", "word", "cid", "comp", "n", F.inline(places))


def _described_classes(docs: DataFrame, key: str, text: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, th, n, k1, k2) of every row, the group and least id of every distinct set, and in how many parts sets of many rows are split."""
    id_type = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    known = stored(rows.mapInArrow(_describe, f"id {id_type}, th bigint, n int, k1 bigint, k2 bigint, sig binary"), "signatures")
    full = known.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("k1", "k2", "n").agg(F.min_by(F.struct("id", "th", "sig"), "id").alias("x"), F.count("*").alias("times"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n", "times", "x.*"), "classes")
    word = lambda b: F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS)
    bands = classes.select("cid", "n", F.posexplode(F.array(*[F.xxhash64(word(b)) for b in range(BANDS)])).alias("band", "word"))
    shared = bands.groupBy("band", "word").agg(F.count("*").alias("m"), *[F.min_by("cid", F.xxhash64("cid", F.lit(f))).alias(f"c{f}") for f in range(FAMILIES)]).where("m > 1")
    shared = stored(shared.select("band", "word", "m", F.get(F.array(*[f"c{f}" for f in range(FAMILIES)]), F.pmod("band", F.lit(FAMILIES))).alias("centre")), "shared")
    bands = stored(bands.join(shared, ["band", "word"]), "bands")
    # of the rows of a class only one is read again
    need = classes.join(bands.select("cid").distinct(), "cid", "left_semi").select("cid", "id", "th")
    again = rows.where("id IS NOT NULL").join(need, ["id", "th"]).select("cid", "id", "th", "text").dropDuplicates(["cid"])
    sets = stored(again.select(F.col("cid").alias("id"), "th", "text").mapInArrow(_sets, "id bigint, th bigint, n int, k1 bigint, k2 bigint, items array<bigint>").select(F.col("id").alias("cid"), "n", "items"), "sets")
    sigs = classes.select("cid", "sig")

    # each member of a band with its centre; a centre's rows are spread by a salt, each with its own copy
    pairs = bands.where("cid <> centre").groupBy(F.col("cid").alias("a"), F.col("centre").alias("b")).agg(F.min(F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / BLOCK))).alias("salt"))
    pairs = stored(pairs, "pairs")

    def beside(pairs: DataFrame, own: DataFrame, value: str) -> DataFrame:
        copies = pairs.select("b", "salt").distinct().join(own.select(F.col("cid").alias("b"), F.col(value).alias("sb")), "b")
        return pairs.join(own.select(F.col("cid").alias("a"), F.col(value).alias("sa")), "a").join(copies, ["b", "salt"])

    likely = stored(beside(pairs, sigs, "sig").select("a", "b", "salt", "sa", "sb").mapInArrow(_likely, "a bigint, b bigint, salt bigint"), "pairs")
    common = F.size(F.array_intersect("sa", "sb"))
    met = beside(likely, sets, "items").withColumn("common", common)
    links = stored(met.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"), "links")
    comp = components(links)
    where = ", ".join(f"{c} {'bigint' if c == 'word' else 'int'}" for c in PLACE)
    near = _blocks(bands.drop("m", "centre"), comp, sets, percent)
    dealt = lambda df: df.repartition(*PLACE).sortWithinPartitions(*PLACE)
    near = stored(dealt(near.join(sigs, "cid")).mapInArrow(_search(percent, False), f"{where}, side int, cid bigint, comp bigint, n int"), "near")
    more = stored(dealt(near.join(sigs, "cid").join(sets.select("cid", "items"), "cid")).mapInArrow(_search(percent, True), "a bigint, b bigint"), "links")
    if more.take(1):
        comp = components(links.unionAll(more))
    discard(shared, bands, sets, pairs, likely, near)
    named = classes.select("cid", "k1", "k2", "n", "id").join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("group", F.coalesce("comp", "cid"))
    least = stored(named.where("comp IS NOT NULL").groupBy("group").agg(F.min("id").alias("least")), "least")
    named = named.join(least, "group", "left")
    total = classes.agg(F.sum("times")).first()[0] or 0
    many = classes.where(F.col("times") * PARTS > total).select("k1", "k2", "n", F.ceil(F.col("times") * PARTS / total).cast("int").alias("parts")) if total else classes.select("k1", "k2", "n", F.lit(1).alias("parts"))
    return known, named.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n").alias("cn"), "group", F.coalesce("least", "id").alias("component")), many


def _placed(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(id, th, n, group, component) of every row; no group without id or words."""
    known, first, many = _described_classes(docs, key, text, percent)
    full = F.col("n") > 0
    many = F.broadcast(many)  # fewer than PARTS rows, since each has more than that share of all
    parts = F.coalesce("parts", F.lit(1))
    rows = known.where(full & F.col("id").isNotNull()).join(many, ["k1", "k2", "n"], "left").withColumn("part", F.pmod(F.xxhash64("id", "th"), parts))
    first = first.join(many.toDF("c1", "c2", "cn", "parts"), ["c1", "c2", "cn"], "left").withColumn("cpart", F.explode(F.sequence(F.lit(0), parts - 1)))
    same = (rows.k1 == first.c1) & (rows.k2 == first.c2) & (rows.n == first.cn) & (rows.part == first.cpart)
    some = rows.join(first, same).select("id", "th", rows.n, "group", "component")
    return some.unionAll(known.where(~full | F.col("id").isNull()).select("id", "th", "n", F.lit(None).cast("long"), F.lit(None).cast(known.schema["id"].dataType)))


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Key, n_shingles, component_id and kept of every document."""
    out = _placed(docs, key, text, percent).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row of each group, with all its columns; rows without id or words all stay."""
    at = stored(_placed(docs, key, text, percent).where("component IS NOT NULL"), "placed")
    # more than one row may be left of a group where an id repeats
    twice = at.where("id = component").groupBy("id", "group").agg(F.count("*").alias("times")).where("times > 1")
    marks = at.where("id <> component").select("id", "th", "group", F.lit(1).alias("mark"))
    marks = marks.unionAll(at.where("id = component").join(twice, ["id", "group"], "left_semi").select("id", "th", "group", F.lit(2))).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # clashing names are out of the way
    own = {c: names[docs.columns.index(c)] for c in (key, text)}
    rows = docs.toDF(*names).withColumn("t", F.xxhash64(F.col(own[text]).cast("string")))
    rows = rows.join(marks, (F.col(own[key]) == F.col("id")) & (F.col("t") == F.col("th")), "left").where("mark IS NULL OR mark = 2")
    one = rows.where("mark = 2").dropDuplicates([own[key], "group"])
    return rows.where("mark IS NULL").unionAll(one).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, w.doc_id = k.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN k ON k.a = w.doc_id
"""

"""A trie of conversations by their first turns, from ternary search trees.

Turns (role and text) are replaced by ids of a dictionary, in the order of their hashes. The
conversations, as lists of ids, are sorted and dealt out in ranges. Each range is put into a ternary
search tree, medians first, which balances it; a pass over its nodes, children before parents,
adds up members, leaves and savings. A range shares nodes with others only along the ways to its
first and its last conversation. These nodes, few for each range, are merged by the hash of their
way; then their sums are carried up in one pass that holds no more than the nodes of one way.

A group of equal conversations may be spread over many ranges, since conversations that are equal
are sorted by their id; ids that end at a shared node are hashed as a stream, piece by piece.

Texts never meet: they are hashed where they are read. A conversation's ids, 16 bytes a turn, are
held in one row. Null roles and texts are empty; rows without conv_id belong to no conversation and
go. Turns are ordered by turn, null first; equal ones by the hash of role and text, so ties and
repeated rows give one result (repeated rows are turns of their own). Very long texts and very long
conversations are taken whole. An empty table gives no node, not even a root. Only the four columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
#: A conversation begins with up to REWIND - 1 turns of the first one of its BLOCK.
BLOCK, REWIND = 20, 4
#: A turn is common if it is more than one in COMMON of all; so at most COMMON turns are.
COMMON = 1000
#: A range has about so many turns.
RANGE = 250_000
#: Ids of a shared node that stand in one row.
PIECE = 1000
NONE_SHA = hashlib.sha256(b"").hexdigest()

NODES = pa.schema(
    [
        ("kind", pa.int32()),  # 0: a node of one range, 1: perhaps a node of more, 2: ids that end at the latter
        ("shard", pa.int64()),
        ("side", pa.int32()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("parent_conv_id", pa.int64()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("words", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
        ("piece", pa.string()),
    ]
)
NODES_DDL = "kind int, shard long, side int, key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, words long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return (F.crc32(conv_id.cast("string")) % REWIND).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, the hash of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    cid = F.col("conv_id").cast("long")
    return conversations.where(cid.isNotNull()).select(cid.alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def dictionary(rows: DataFrame) -> DataFrame:
    """Each different turn: key, words, n (how often it occurs) and id, in the order of keys."""
    return numbered(rows.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n")), F.col("key"), name="id")


def encoded(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """Rows with their turn's id. Common turns, few by their definition, are broadcast; the others are joined."""
    common = F.col("n") * COMMON > total
    few = F.broadcast(known.where(common).select("key", "id"))
    rest = rows.join(F.broadcast(known.where(common).select("key")), "key", "left_anti").join(known.where(~common).select("key", "id"), "key")
    return rows.join(few, "key").unionByName(rest).select("conv_id", "turn", "id", "words")


def rebuilt(coded: DataFrame) -> DataFrame:
    """Every conversation with the turns it takes: conv_id, ids and words."""
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("own"))
    own = stored(own.select("conv_id", F.transform("own", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("own")), "conversations")
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    lead = own.where(F.col("conv_id") == first).select(F.col("conv_id").alias("block"), F.slice("own", 1, REWIND - 1).alias("lead"))
    h = borrowed(F.col("conv_id"))
    taken = F.slice(F.coalesce("lead", F.slice("own", 1, 0)), F.lit(1), h)
    both = F.concat(taken, F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    whole = own.withColumn("block", first).join(lead, "block", "left").select("conv_id", both.alias("all"))
    return whole.select("conv_id", F.col("all.id").alias("ids"), F.col("all.words").alias("words"))


class Tree:
    """A ternary search tree over lists of turn ids.

    Node 0 is the root. The children of a node are a binary tree of their own: `middle` leads to
    its top, `lower` and `higher` to smaller and larger turns beside it. A node's parent always has
    a smaller number.
    """

    def __init__(self) -> None:
        self.turn, self.words, self.parent, self.depth, self.lower, self.middle, self.higher = (array("q") for _ in range(7))
        self._new(-1, 0, 0, 0)

    def _new(self, parent: int, turn: int, words: int, depth: int) -> int:
        for column, v in ((self.turn, turn), (self.words, words), (self.parent, parent), (self.depth, depth), (self.lower, -1), (self.middle, -1), (self.higher, -1)):
            column.append(v)
        return len(self.turn) - 1

    def insert(self, ids: list[int], words: list[int]) -> int:
        """The node of a list, with all nodes on its way."""
        node, turn, lower, higher = 0, self.turn, self.lower, self.higher
        for depth, (t, w) in enumerate(zip(ids, words, strict=True), 1):
            at = self.middle[node]
            if at < 0:
                at = self.middle[node] = self._new(node, t, w, depth)
            while turn[at] != t:
                side = lower if t < turn[at] else higher
                if side[at] < 0:
                    side[at] = self._new(node, t, w, depth)
                at = side[at]
            node = at
        return node

    def way(self, node: int) -> list[int]:
        """From the root to a node."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    ranges = [(0, n)]
    while ranges:
        wide = []
        for a, b in ranges:
            if a < b:
                m = (a + b) // 2
                yield m
                wide += [(a, m), (m + 1, b)]
        ranges = wide


def listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _distinct(batches: Iterator[pa.RecordBatch]) -> tuple[list, list[np.ndarray]]:
    """Different lists of a sorted range with their words, and the conversations of each."""
    lists, members, last = [], [], None
    for batch in batches:
        convs = batch.column("conv_id").to_numpy()
        ids, words = batch.column("ids"), batch.column("words")
        ends = ids.offsets.to_numpy()
        # the lists of a batch may be a part of longer ones
        flat, flat_words, starts = ids.values.to_numpy(zero_copy_only=False), words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
        for i, conv in enumerate(convs.tolist()):
            here = flat[ends[i] : ends[i + 1]].tobytes()
            if here != last:
                lists.append((here, flat_words[starts[i] : starts[i + 1]].tobytes()))
                members.append(array("q"))
                last = here
            members[-1].append(conv)
    return lists, [np.frombuffer(m, np.int64) for m in members]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of one sorted range: nodes that are its own, and those that others may have too."""
    shard = TaskContext.get().partitionId()
    lists, members = _distinct(batches)
    if not lists:
        return
    tree, at = Tree(), [0] * len(lists)
    for i in medians(len(lists)):
        at[i] = tree.insert(*(np.frombuffer(x, np.int64).tolist() for x in lists[i]))
    size = len(tree.turn)
    n, children, leaves, saved = (array("q", bytes(8 * size)) for _ in range(4))
    least = array("q", [2**63 - 1]) * size
    ending = dict(zip(at, members, strict=True))
    for node, convs in ending.items():
        n[node], least[node] = len(convs), int(convs[0])
    left, right = tree.way(at[0]), tree.way(at[-1])
    shared = dict.fromkeys(right, 1) | dict.fromkeys(left, 0)
    keys = {0: hashlib.blake2b(digest_size=16).digest()}
    for way in (left, right):
        for node in way[1:]:
            keys[node] = hashlib.blake2b(keys[tree.parent[node]] + tree.turn[node].to_bytes(8, "little"), digest_size=16).digest()
    for v in range(size - 1, -1, -1):
        p = tree.parent[v]
        if v not in shared:
            leaves[v] += not children[v]
            saved[v] += (n[v] - 1) * tree.words[v]
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
        if p >= 0:
            n[p] += n[v]
            least[p] = min(least[p], least[v])

    rows = []
    for v in range(size):
        convs, p = ending.get(v), tree.parent[v]
        common = (tree.depth[v], tree.words[v], n[v], children[v], leaves[v], saved[v])
        if v in shared:
            rows.append((1, shard, shared[v], keys[v], keys.get(p), None, least[v], *common, None, None))
            if convs is not None:
                rows += [(2, shard, i, keys[v], None, None, None, *[None] * 6, None, listed(convs[i : i + PIECE])) for i in range(0, len(convs), PIECE)]
        else:
            sha = NONE_SHA if convs is None else hashlib.sha256(listed(convs).encode()).hexdigest()
            rows.append((0, shard, None, None, keys.get(p), None if p in shared else least[p], least[v], *common, sha, None))
        if len(rows) >= 8192:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple], schema: pa.Schema = NODES) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shared node, from rows sorted by key, kind, shard and place of the piece."""
    node, sha = None, None

    def ended() -> tuple:
        return (*[node[c] for c in NODES.names[:-2]], sha.hexdigest(), None)

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if node is None or r["key"] != node["key"]:
                if node is not None:
                    out.append(ended())
                node, sha, found = r, hashlib.sha256(), False
            elif r["kind"] == 1:
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += r[c]
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
            else:
                sha.update(("," + r["piece"] if found else r["piece"]).encode())
                found = True
        yield _batch(out)
    if node is not None:
        yield _batch([ended()])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the shared nodes with those below them, from rows in the order of a walk through the tree."""
    way: list[dict] = []
    out: list[tuple] = []

    def leave() -> None:
        v = way.pop()
        v["n_leaves"] += not v["n_children"]
        v["saved_tokens"] += (v["n_convs"] - 1) * v["words"]
        if way:
            for c in ("n_leaves", "saved_tokens"):
                way[-1][c] += v[c]
        out.append(tuple(v[c] for c in NODES.names))

    for batch in batches:
        for r in batch.to_pylist():
            while way and way[-1]["depth"] >= r["depth"]:
                leave()
            if way and way[-1]["key"] != r["parent_key"]:
                raise ValueError("shared nodes are out of order")
            if way:
                way[-1]["n_children"] += 1
                r["parent_conv_id"] = way[-1]["conv_id"]
            way.append(r)
        yield _batch(out)
        out.clear()
    while way:
        leave()
    yield _batch(out)


def trie(conversations: DataFrame, turns_a_range: int = RANGE) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    rows = stored(turns(conversations), "turns")
    known = stored(dictionary(rows), "dictionary")
    total = known.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // turns_a_range))
    whole = rebuilt(encoded(rows, known, total))
    dealt = whole.repartitionByRange(ranges, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = stored(dealt.mapInArrow(_nodes, NODES_DDL), "nodes")
    discard(rows, known)

    shared = nodes.where("kind > 0")
    merged = stored(shared.repartition("key").sortWithinPartitions("key", "kind", "shard", "side").mapInArrow(_merged, NODES_DDL), "shared")
    # a node's first range, and in it the way to the first conversation before the way to the last
    carried = merged.repartition(1).sortWithinPartitions("shard", "side", "depth").mapInArrow(_carried, NODES_DDL)
    own = nodes.where("kind = 0")
    # parents that are shared: their least conversation for each range, so that no key is hot
    parents = nodes.where("kind = 1").select("shard", "key").join(merged.select("key", F.col("conv_id").alias("above")), "key").select("shard", F.col("key").alias("parent_key"), "above")
    below = own.where("parent_conv_id IS NULL").join(parents, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    return own.where("parent_conv_id IS NOT NULL").select(RESULT).unionByName(below.select(RESULT)).unionByName(carried.select(RESULT))


SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS block,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.block AND t.k <= c.h UNION ALL SELECT c.conv_id, t.k + 1000000000, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, role, text FROM r),
p AS (SELECT a.conv_id, a.d, a.text, sha256(string_agg(b.role || chr(1) || length(b.text) || chr(2) || b.text, chr(3) ORDER BY b.d)) AS node
  FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.d <= a.d GROUP BY a.conv_id, a.d, a.text UNION ALL SELECT conv_id, 0, '', '' FROM c),
e AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
n AS (SELECT node, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved FROM p GROUP BY node),
u AS (SELECT x.node, a.node AS up, x.saved, x.depth, q.depth AS up_depth, q.conv_id AS up_conv FROM n x JOIN p a ON a.conv_id = x.conv_id AND a.d <= x.depth JOIN n q ON q.node = a.node),
k AS (SELECT up AS node, count(*) AS n_children FROM u WHERE up_depth = depth - 1 GROUP BY up),
s AS (SELECT up AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE u.node NOT IN (SELECT node FROM k)) AS n_leaves FROM u GROUP BY up),
x AS (SELECT p.node, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM p JOIN e USING (conv_id, d) GROUP BY p.node),
o AS (SELECT node, up_conv FROM u WHERE up_depth = depth - 1)
SELECT n.conv_id, n.depth, o.up_conv AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN k USING (node) JOIN s USING (node) LEFT JOIN x USING (node) LEFT JOIN o USING (node)
"""

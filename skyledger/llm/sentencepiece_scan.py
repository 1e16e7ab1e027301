"""SentencePiece encoding and decoding as a max-plus scan.

The given tokenizer merges pairs, so its result is no best sum of scores. But a segmentation is
the tokenizer's own exactly if each two neighbours, merged alone, stay as they are. With weight 0
for such a pair and minus infinity for others, the segmentation is the best path of a max-plus
recurrence over the places of a text, and a place needs no more state than its last piece. All
texts are traced by this recurrence, in linear time.

Texts of more than CHUNK characters are cut into chunks. The state of a path at the boundary of two
chunks is the piece that ends there or lies across it. Each chunk gives its transfer matrix: which
state at its end can follow which state at its beginning (weight 0, else minus infinity). The
matrices are multiplied in order, which is associative; then the one path that is left is followed
back from the end, and each chunk is traced again on its own between its two states. No piece has a
space mark behind another character, so a text falls into segments that begin with space marks, and
a chunk in which a segment begins has a matrix of rank one.

Null texts have no tokens and a null round trip; the empty text has none and a true one. Very long
texts give what shorter ones do, with or without spaces. There are no ties: a text has one path.
Rows are coded one by one, so repeated rows get equal results; an empty table gives an empty one.
Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_structs, stored, struct_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Where a segment begins behind another one.
START = re.compile(f"(?<!{MARK}){MARK}")
CHUNK = 1 << 16
#: So many segments of so many characters at most are remembered.
CACHE, REMEMBERED = 350_000, 48
FIELDS = [("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]


#: For a state at the beginning, the states at the end that weigh 0; all others weigh minus infinity.
Matrix = dict[tuple[int, int], list[tuple[int, int]]]


def product(first: Matrix, second: Matrix) -> Matrix:
    """The matrix of two runs of chunks, one behind the other; associative."""
    return {i: sorted({k for j in js for k in second.get(j, ())}) for i, js in first.items()}


def followed(matrices: list[Matrix]) -> list[tuple[int, int]]:
    """The states of the one whole path: at the beginning, between the chunks, at the end. An error where there is none."""
    sums = list(accumulate(matrices, product))

    def only(states: list[tuple[int, int]]) -> tuple[int, int]:
        if len(states) != 1:
            raise ValueError(f"{len(states)} paths through a text's chunks, not one: the pieces do not come from merges alone")
        return states[0]

    path = [only(sums[-1].get((0, 0), []))]
    for k in range(len(matrices) - 1, 0, -1):
        path.append(only([i for i in sums[k - 1][0, 0] if path[-1] in matrices[k].get(i, ())]))
    return [(0, 0), *path[::-1]]


@dataclass
class Vocabulary:
    """Pieces with ids and scores, and the ids of single bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    texts: dict[int, bytes] = field(default_factory=dict)
    root: dict = field(default_factory=dict)
    width: int = 1
    pairs: dict[str, dict[str, bool]] = field(default_factory=dict)
    n_pairs: int = 0
    cache: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids = {}, {}, [-1] * 256
        out = cls(ids, scores, byte_ids, p.unk_id())
        out.texts = dict.fromkeys(range(p.get_piece_size()), b"")
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                out.texts[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a space mark inside the piece {piece!r}")
                ids[piece], scores[piece] = i, p.get_score(i)
                out.texts[i] = piece.replace(MARK, " ").encode()
        # a tree of characters; under the empty string the pieces met so far, shortest first
        for piece in sorted(ids):
            node, met = out.root, ()
            for c in piece:
                node = node.setdefault(c, {"": met or (c,)})
                met = node[""]
            node[""] = met if met[-1] == piece else (*met, piece)
            out.width = max(out.width, len(piece))
        return out

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is left."""
        parts, score, none = list(text), self.scores.get, -math.inf
        worth = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while worth and (best := max(worth)) != none:
            i = worth.index(best)
            parts[i] += parts.pop(i + 1)
            del worth[i]
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _fits(self, left: str, right: str, row: dict[str, bool]) -> bool:
        """The weight of a pair: whether it stays as it is. `left` is empty at a segment's start."""
        if self.n_pairs >= 1_000_000:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        row[right] = self.merged(left + right) == ([left, right] if left else [right])
        return row[right]

    def beginning(self, text: str, start: int) -> tuple[str, ...]:
        """The pieces that the text has at a place, shortest first; one character is always one."""
        node = self.root
        for c in text[start : start + self.width]:
            deeper = node.get(c)
            if deeper is None:
                break
            node = deeper
        return node.get("") or (text[start],)

    def advance(self, text: str, left: str, stop: int) -> list[str | None]:
        """The last piece of each place that paths behind `left` reach by pieces that begin before `stop`."""
        n, pairs = len(text), self.pairs
        last: list[str | None] = [None] * (n + 1)
        last[0], far = left, 0
        for start in range(min(n, stop)):
            left = last[start]
            if left is None:
                if start > far:  # no path goes on
                    break
                continue
            row = pairs.get(left)
            if row is None:
                row = pairs[left] = {}
            for piece in self.beginning(text, start):
                end = start + len(piece)
                # each place has one path only, so what is reached is not tried again
                if last[end] is None:
                    fits = row.get(piece)
                    if self._fits(left, piece, row) if fits is None else fits:
                        last[end] = piece
                        far = max(far, end)
        return last

    def traced(self, text: str, left: str = "") -> list[str]:
        """Pieces of a text within one segment: the path of the recurrence, longest pieces first.

        No path weighs more than 0, so the first one to reach the end is the best; a place from
        which none does is not entered again, so the time is linear.
        """
        n, place, pairs, beginning = len(text), 0, self.pairs, self.beginning
        out, others, dead = [], [], set()
        options = beginning(text, 0) if text else ()
        k = len(options)
        while place < n:
            row = pairs.get(left)
            if row is None:
                row = pairs[left] = {}
            while k:
                k -= 1
                piece = options[k]
                fits = row.get(piece)
                if (self._fits(left, piece, row) if fits is None else fits) and place + len(piece) not in dead:
                    out.append(piece)
                    others.append((options, k, left))
                    place += len(piece)
                    left = piece
                    if place < n:
                        options = beginning(text, place)
                        k = len(options)
                    break
            else:
                dead.add(place)
                place -= len(out.pop())
                options, k, left = others.pop()
        return out

    def coded(self, pieces: list[str]) -> bytes:
        """Ids of pieces, two bytes each."""
        out: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            else:
                out.extend(k if k >= 0 else self.unknown for k in (self.byte_ids[b] for b in piece.encode()))
        return array("H", out).tobytes()

    def segment(self, text: str) -> bytes:
        """Ids of one segment, two bytes each."""
        got = self.older.get(text)
        if got is not None:
            self.cache[text] = got
            return got
        got = self.coded(self.traced(text))
        if len(text) <= REMEMBERED:
            if len(self.cache) >= CACHE:  # what is used again moves on
                self.older, self.cache = self.cache, {}
            self.cache[text] = got
        return got

    def encode(self, marked: str) -> np.ndarray:
        """Ids of a text with space marks that begins where a segment does."""
        known = self.cache.get
        return np.frombuffer(b"".join([known(s) or self.segment(s) for s in SEGMENT.findall(marked)]), np.uint16)

    def states(self, text: str, a: int) -> list[tuple[int, int]]:
        """Pieces that end at place `a` or lie across it, from and to, counted from `a`; (0, 0) where the text begins."""
        if a == 0:
            return [(0, 0)]
        spans = [(p, e) for p in range(max(0, a - self.width), a) for e in range(a, min(p + self.width, len(text)) + 1)]
        return [(p - a, e - a) for p, e in spans if e == p + 1 or text[p:e] in self.ids]

    def transfer(self, text: str, a: int, b: int) -> Matrix:
        """The states at `b` that can follow each state at `a`. Before a and behind b stand as many characters as a piece may have."""

        def leaving(start: int, left: str) -> list[tuple[int, int]]:
            last = self.advance(text[start : b + self.width], left, b - start)
            ends = ((e, last[e - start]) for e in range(b, min(b + self.width, len(text)) + 1))
            return [(e - b - len(x), e - b) for e, x in ends if x and e - len(x) < b]

        starts = [m.start() for m in START.finditer(text, a, b)]
        behind = leaving(starts[-1], "") if starts else []
        out = {}
        for p, e in self.states(text, a):
            start, left = a + e, text[a + p : a + e]
            if start >= b:  # the last chunk has nothing of its own
                out[p, e] = [(a + p - b, start - b)]
            elif not starts:
                out[p, e] = leaving(start, "" if START.match(text, start) else left)
            elif start == starts[0] or self.advance(text[start : starts[0]], left, starts[0] - start)[-1] is not None:
                out[p, e] = behind
        return {i: js for i, js in out.items() if js}

    def between(self, text: str, start: int, stop: int, left: str) -> np.ndarray:
        """Ids of text[start:stop], whose path goes on behind the piece `left`."""
        if start >= stop:
            return np.zeros(0, np.uint16)
        if not left or START.match(text, start):
            return self.encode(text[start:stop])
        found = START.search(text, start, stop)
        cut = found.start() if found else stop
        return np.concatenate([np.frombuffer(self.coded(self.traced(text[start:cut], left)), np.uint16), self.encode(text[cut:stop])])

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        data = b"".join([self.texts[i] for i in ids.tolist()])
        return (data[1:] if first and data[:1] == b" " else data).decode("utf-8", "replace")


def marked(text: str) -> str:
    return (MARK + text.replace(" ", MARK)) if text else ""


def _short(vocabulary):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary.value
        for batch in batches:
            ids, same = [], []
            for t in batch.to_pylist():
                ids.append(v.encode(marked(t or "")))
                same.append(None if t is None else v.decode(ids[-1]) == t)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint16), *ids]).astype(np.int32)))
            yield concat_structs([struct_of(FIELDS, [lists, same])], FIELDS)

    return F.arrow_udf(run, "ids array<int>, round_trip boolean")


def _matrices(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        for b in batches:
            found = [v.transfer(lead + body + trail, len(lead), len(lead) + len(body)) for lead, body, trail in zip(b["lead"], b["body"], b["trail"], strict=True)]
            yield pd.DataFrame({"row": b["row"], "at": b["at"], "moves": [[x for i, js in m.items() for j in js for x in (*i, *j)] for m in found]})

    return run


def _paths(rows: pd.DataFrame) -> pd.DataFrame:
    """The state at both ends of each chunk of a text."""
    rows = rows.sort_values("at")
    matrices: list[Matrix] = []
    for moves in rows["moves"]:
        m: Matrix = {}
        for p, e, q, f in np.asarray(moves).reshape(-1, 4).tolist():
            m.setdefault((p, e), []).append((q, f))
        matrices.append(m)
    path = followed(matrices)
    return pd.DataFrame({"row": rows["row"].to_numpy(), "at": rows["at"].to_numpy(), "p": [i[0] for i in path[:-1]], "e": [i[1] for i in path[:-1]], "f": [j[1] for j in path[1:]]})


def _chunk(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        for b in batches:
            ids, same = [], []
            for at, lead, body, trail, p, e, f in zip(*(b[c] for c in ("at", "lead", "body", "trail", "p", "e", "f")), strict=True):
                text, a = lead + body + trail, len(lead)
                start, stop = a + e, a + len(body) + f
                ids.append(v.between(text, start, stop, text[a + p : start]))
                same.append(v.decode(ids[-1], at == 0) == text[start + int(at == 0) : stop].replace(MARK, " "))
            yield pd.DataFrame({"row": b["row"], "at": b["at"], "ids": [x.astype(np.int32) for x in ids], "same": same})

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Key, ids and round_trip (decoding gives the text again) of every document."""
    if chunk < 2 * vocabulary.width:
        raise ValueError("a chunk must be longer than two pieces")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~long).select("key", _short(held)(F.col("text")).alias("p")).select("key", "p.ids", "p.round_trip")
    giant = stored(rows.where(long).withColumn("row", F.monotonically_increasing_id()).withColumn("has_mark", F.col("text").contains(MARK)), "giants")
    if not giant.take(1):
        return short
    # one pass over a text gives all its chunks, each with the ends of its neighbours
    bodies = F.regexp_extract_all(F.concat(F.lit(MARK), F.translate("text", " ", MARK)), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    beside = lambda i, end: F.coalesce(end(F.get("bodies", i), F.lit(vocabulary.width)), F.lit(""))
    each = F.transform("bodies", lambda x, i: F.struct(beside(i - 1, F.right).alias("lead"), x.alias("body"), beside(i + 1, F.left).alias("trail")))
    parts = giant.select("row", bodies.alias("bodies")).select("row", F.posexplode(each).alias("at", "part")).select("row", "at", "part.*")
    parts = stored(parts.repartition("row", "at"), "chunks")
    moves = parts.mapInPandas(_matrices(held), "row bigint, at int, moves array<int>")
    paths = moves.groupBy("row").applyInPandas(_paths, "row bigint, at int, p int, e int, f int")
    coded = parts.join(paths, ["row", "at"]).mapInPandas(_chunk(held), "row bigint, at int, ids array<int>, same boolean")
    whole = coded.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"), F.min("same").alias("round_trip"))
    return short.unionAll(giant.select("row", "key", "has_mark").join(whole, "row").select("key", "ids", F.col("round_trip") & ~F.col("has_mark")))


def digest(coded: DataFrame) -> DataFrame:
    """The columns of a report on coded documents."""
    return coded.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "round_trip")

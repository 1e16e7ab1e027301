"""Token counts by finite-state transducers compiled from a public tokenizer.

The tokenizer breaks a text into words by character classes and merges each word's bytes. A list
of tokens is its own result exactly if each two neighbours, merged alone, stay as they are. So the
last token of every beginning of a word depends only on the last tokens of the places before it
from which a token may still go on; these are a state. Reading a byte leads to one next state, and
emits how many tokens the beginning has more (or fewer) than the one before it. States and moves
are compiled when they are first needed. The stage before it, character classes and the special
strings, is compiled from the library's own answers for every code point.

Texts of more than CHUNK characters are cut into chunks, where possible between two words. Where a
word of one class goes on for a whole chunk, the cut lies within it: then a chunk gives a map from
the tokens that may end at or lie across its beginning to those at its end, with the tokens
counted. Maps compose associatively, block by block, then over the blocks.

Null and empty texts have 0 tokens and 0 bytes. Very long texts, with or without blanks, give what
the library gives. There are no ties; rows are counted one by one, so repeated rows get equal
results and an empty table an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_structs, slices, stored, struct_of

MODEL = "/opt/tokenizers/word_bpe_49k.json"
LIMIT = 2048
CHUNK = 1 << 16
#: Maps of so many chunks are composed at a time.
BLOCK = 256
#: States that are held, words whose counts are remembered, and the longest of these in characters.
STATES, REMEMBERED, LONGEST = 120_000, 250_000, 40
#: Classes of characters; PLAIN ones stay one character of their class whatever stands beside them.
SPACE, LETTER, NUMBER, OTHER, PLAIN = 0, 1, 2, 3, 4
#: Below this code point no character joins another one, and lower case is what Python's is.
SIMPLE = 0x300
END = b"\xff</w>"  # no UTF-8 text holds the first byte
FIELDS = [("n_bytes", pa.int64()), ("n_tokens", pa.int64())]

#: For (back, ahead) of a token at a chunk's beginning, those at its end with the tokens that begin between.
Map = dict[tuple[int, int], dict[tuple[int, int], int]]
FRESH = (0, 0)


def composed(first: Map, second: Map) -> Map:
    """The map of two runs of chunks, one behind the other; associative."""
    return {i: {k: n + m for j, n in js.items() for k, m in second.get(j, {}).items()} for i, js in first.items()}


@dataclass(frozen=True)
class Tokenizer:
    """What is known about the tokenizer: merges, tokens, special strings, character classes."""

    path: str
    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: list[str]
    kinds: bytes
    ranges: dict[int, str]
    width: int

    @classmethod
    def load(cls, path: str = MODEL) -> Tokenizer:
        import tokenizers

        described = json.load(open(path))
        model = described["model"]
        if model["end_of_word_suffix"] != "</w>" or model["continuing_subword_prefix"] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in described["added_tokens"]):
            raise ValueError(f"{path} holds a tokenizer of another kind")
        # bytes stand as characters: printable ones as they are, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(of[c] for c in (token[:-4] if ends else token)) + END * ends

        ids = {raw(t): i for t, i in model["vocab"].items()}
        ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(model["merges"])}
        lib = tokenizers.Tokenizer.from_file(path)
        kinds, ranges = _classes(lib)
        return cls(path, ids, ranks, [x["content"] for x in described["added_tokens"]], kinds, ranges, max(len(t.removesuffix(END)) for t in ids))


def _classes(lib) -> tuple[bytes, dict[int, str]]:
    """The class of every code point, and each class as ranges for a pattern, from the library's answers."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    kind = bytearray([OTHER]) * 0x110000
    for k, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for _, (a, b) in pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(everything):
            for c in points[a:b]:
                kind[c] = k
    ranges = {}
    for k in (SPACE, LETTER, NUMBER, OTHER):
        found = np.flatnonzero(np.frombuffer(kind, np.uint8) == k)
        cuts = np.flatnonzero(np.diff(found) > 1)
        firsts, lasts = found[np.r_[0, cuts + 1]], found[np.r_[cuts, len(found) - 1]]
        ranges[k] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))
    # what may join a character before it
    second = {int(d.split()[1], 16) for c in points if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d} | set(range(0x1161, 0x1200))
    shown = [c for c in points if kind[c] != SPACE]
    alone = lib.normalizer.normalize_str(" ".join(map(chr, shown))).split(" ")
    if len(alone) != len(shown):
        raise ValueError("a character turns into a blank")
    for c, x in zip(shown, alone, strict=True):
        if len(x) == 1 and kind[c] & 3 == kind[ord(x)] & 3 and not unicodedata.combining(chr(c)) and c not in second:
            kind[c] |= PLAIN
    return bytes(kind), ranges


@dataclass
class Transducer:
    """Counts tokens. State 0 stands before a word."""

    tokenizer: Tokenizer
    moves: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    states: list[tuple] = field(default_factory=list)
    numbers: dict[tuple, int] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)
    older: dict[str, int] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import tokenizers

        t = self.tokenizer
        self.begun = {x[:k] for x in (y.removesuffix(END) for y in t.ids) for k in range(len(x))} | {y.removesuffix(END) for y in t.ids if y.endswith(END)}
        r = t.ranges
        every = f"'s|'t|'re|'ve|'m|'ll|'d|[{r[LETTER]}]+|[{r[NUMBER]}]|[{r[OTHER]}]+"
        self.any_words = re.compile(every)
        # the same for texts of simple characters: a class of few ranges is quicker
        few = re.compile(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})")
        self.simple_words = re.compile(few.sub(lambda m: m[0] if int(m[2], 16) < SIMPLE else f"\\U{m[1]}-\\U{SIMPLE - 1:08x}" if int(m[1], 16) < SIMPLE else "", every))
        self.runs = {k: re.compile(f"[{r[k]}]*") for k in (LETTER, OTHER)}
        self.special = re.compile("|".join(map(re.escape, sorted(t.special, key=len, reverse=True))) or "(?!)")
        self.odd = re.compile(f"[{chr(SIMPLE)}-\U0010ffff]")
        self.library = tokenizers.Tokenizer.from_file(t.path).normalizer
        self._forget()

    def _forget(self) -> None:
        self.moves[:], self.states[:] = [{}], [(b"", ((b"", 0),))]
        self.numbers.clear()
        self.numbers[self.states[0]] = 0

    # the merges

    def merged(self, data: bytes) -> list[bytes]:
        """Merge the neighbours of the least rank, leftmost first; END may stand at the end."""
        body = data.removesuffix(END)
        parts = [body[i : i + 1] for i in range(len(body))]
        if len(body) < len(data):
            parts[-1] += END
        rank, none = self.tokenizer.ranks.get, len(self.tokenizer.ranks)
        while len(parts) > 1:
            worth = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
            best = min(worth)
            if best == none:
                break
            i = worth.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay as they are beside each other. `left` is empty at a word's beginning."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    # the transducer of bytes

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The move of a state on a byte; behind 256 the byte ends the word."""
        suffix, places = self.states[state]
        data = suffix + bytes([symbol & 255])
        for size in range(len(data), 0, -1):
            token = data[-size:] + (END if symbol > 255 else b"")
            if token in self.tokenizer.ids and self.fits(places[size - 1][0], token):
                emitted = places[size - 1][1] + 1
                break
        else:
            raise ValueError("a byte has no token")
        if symbol > 255:
            move = (0, emitted)
        else:
            live = next(k for k in range(len(data), -1, -1) if data[len(data) - k :] in self.begun)
            then = (data[len(data) - live :], ((token, 0), *((t, n - emitted) for t, n in places[:live])))
            number = self.numbers.get(then)
            if number is None:
                number = self.numbers[then] = len(self.states)
                self.states.append(then)
                self.moves.append({})
            move = (number, emitted)
        self.moves[state][symbol] = move
        return move

    def word(self, word: str) -> int:
        """Tokens of one word."""
        n = self.known.get(word) or self.older.get(word) or self._read(word.encode())
        if word not in self.known and len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:  # what is used again moves on
                self.older, self.known = self.known, {}
            self.known[word] = n
        return n

    def _read(self, data: bytes) -> int:
        if len(self.states) > STATES:
            self._forget()
        at, n, moves = 0, 0, self.moves
        for b in data[:-1]:
            move = moves[at].get(b) or self._compile(at, b)
            at, n = move[0], n + move[1]
        last = data[-1] + 256
        return n + (moves[at].get(last) or self._compile(at, last))[1]

    # the stage before it

    def plain(self, text: str) -> str:
        """The text as the library changes it before words are sought."""
        return self.library.normalize_str(text) if self.odd.search(text) else text.lower()

    def words(self, plain: str) -> list[str]:
        """The words of a changed text."""
        return (self.any_words if self.odd.search(plain) else self.simple_words).findall(plain)

    def counted(self, words: list[str]) -> int:
        known, word = self.known.get, self.word
        return sum([known(w) or word(w) for w in words])

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.counted(self.words(self.plain(part))) for part in parts)

    # long texts

    def _apart(self, text: str, p: int) -> bool:
        """Whether a word ends at a place, whatever stands around it."""
        a, b = self.tokenizer.kinds[ord(text[p - 1])], self.tokenizer.kinds[ord(text[p])]
        if b & 3 == SPACE:
            return True
        if not (b & PLAIN and (a & PLAIN or a & 3 == SPACE)) or self._near(text, p):
            return False
        return (a & 3 != b & 3 or b & 3 == NUMBER) and not (text[p - 1] == "'" and b & 3 == LETTER)

    def _near(self, text: str, p: int) -> bool:
        """Whether a special string may lie across a place."""
        far = max(map(len, self.tokenizer.special), default=0)
        return self.special.search(text, max(0, p - far + 1), p + far - 1) is not None

    def _within(self, text: str, p: int) -> bool:
        """Whether a place lies within a word whose last characters are all plain and of one class."""
        around = {self.tokenizer.kinds[ord(c)] for c in text[p - self.tokenizer.width : p + 1]}
        return len(around) == 1 and around.pop() in (LETTER | PLAIN, OTHER | PLAIN) and not self._near(text, p)

    def chunks(self, text: str, size: int = CHUNK) -> Iterator[tuple[int, int, bool]]:
        """Where chunks begin and end, and whether the end lies within a word. A chunk is longer only where no place will do."""
        begin, width = 0, self.tokenizer.width
        while begin < len(text):
            end, within = begin + size, False
            if end >= len(text):
                yield begin, len(text), False
                return
            low = begin + max(size // 2, width + 1)
            found = next((p for p in range(end, low, -1) if self._apart(text, p)), None)
            if found is None:
                found = next((p for p in range(end, low, -1) if self._within(text, p)), None)
                within = found is not None
            while found is None:
                end += 1
                if end >= len(text) or self._apart(text, end):
                    found = min(end, len(text))
                elif self._within(text, end):
                    found, within = end, True
            yield begin, found, within
            begin = found

    def _tokens(self, data: bytes, at: int, end: int | None) -> Iterator[bytes]:
        """The tokens that data has at a place; those that reach `end`, the end of the word, are closed."""
        for stop in range(at + 1, min(at + self.tokenizer.width, len(data) if end is None else end) + 1):
            token = data[at:stop] + (END if stop == end else b"")
            if token in self.tokenizer.ids:
                yield token
            if data[at:stop] not in self.begun:
                return

    def _ways(self, data: bytes, start: int, left: bytes, stop: int, end: int | None) -> dict[tuple[int, int], int]:
        """From a place behind `left`: the tokens that end at or lie across `stop`, and how many begin before it."""
        reached: dict[int, tuple[bytes, int]] = {start: (left, 0)}
        for at in range(start, stop):
            if at in reached:
                before, n = reached[at]
                for token in self._tokens(data, at, end):
                    to = at + len(token.removesuffix(END))
                    if to not in reached and self.fits(before, token):
                        reached[to] = (token, n + 1)
        return {(stop - to + len(t.removesuffix(END)), to - stop): n for to, (t, n) in reached.items() if to >= stop and to > start}

    def transfer(self, lead: str, body: str, trail: str, opened: bool, within: bool) -> Map:
        """The map of a chunk. `opened`: its beginning lies within a word; `within`: its end does."""
        parts = self.special.split(body)
        first, last = self.plain(parts[0]), None
        ahead = self.plain(trail).encode() if within else b""
        head = self.runs[self.tokenizer.kinds[ord(lead[-1])] & 3].match(first).group() if opened else ""
        whole = opened and within and len(parts) == 1 and head == first
        rest = [first[len(head) :], *map(self.plain, parts[1:])]
        words = [self.words(x) for x in rest]
        if within and not whole:
            last = words[-1].pop().encode()
        middle = len(parts) - 1 + sum(map(self.counted, words))

        # from the beginning of the last word to the chunk's end
        behind = {FRESH: middle}
        if last is not None:
            follow = self.runs[self.tokenizer.kinds[ord(body[-1])] & 3].match(ahead.decode()).group()
            end = len(last) + len(follow.encode()) if len(follow.encode()) < len(ahead) or len(ahead) < self.tokenizer.width else None
            behind = {k: middle + n for k, n in self._ways(last + follow.encode(), 0, b"", len(last), end).items()}
        if not opened:
            return {FRESH: behind}

        own, before = head.encode(), self.plain(lead).encode()[-self.tokenizer.width :]
        a, stop = len(before), len(before) + len(own)
        if whole:
            follow = self.runs[self.tokenizer.kinds[ord(lead[-1])] & 3].match(ahead.decode()).group().encode()
            end = stop + len(follow) if len(follow) < len(ahead) or len(ahead) < self.tokenizer.width else None
        else:
            follow, end = b"", stop
        data = before + own + follow
        out: Map = {}
        for start in range(a):
            for token in self._tokens(data, start, end):
                to = start + len(token.removesuffix(END))
                if to < a:
                    continue
                state = (a - start, to - a)
                if whole:
                    found = {(stop - start, to - stop): 0} if to >= stop else self._ways(data, to, token, stop, end)
                elif to == stop:  # the word ends with this token
                    found = behind
                else:
                    found = {k: m + n for m in list(self._ways(data, to, token, stop, end).values())[:1] for k, n in behind.items()}
                if found:
                    out[state] = found
        return out


def _short(held):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = Transducer(held.value)
        for batch in batches:
            parts = []
            for piece in slices(batch.fill_null(""), 1 << 22):
                texts = piece.to_pylist()
                parts.append(struct_of(FIELDS, [[len(x) for x in piece.cast(pa.binary()).to_pylist()], [t.count(x) for x in texts]]))
            yield concat_structs(parts, FIELDS)

    return F.arrow_udf(run, "n_bytes bigint, n_tokens bigint")


def _cut(held, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(held.value)
        width = t.tokenizer.width
        for batch in batches:
            for i, row in enumerate(batch.column("row").to_pylist()):
                text, opened = batch.column("text")[i].as_py(), False
                for at, (a, b, within) in enumerate(t.chunks(text, size)):
                    one = {"row": [row], "at": [at], "lead": [text[max(0, a - width) : a]], "body": [text[a:b]], "trail": [text[b : b + width]], "opened": [opened], "within": [within]}
                    yield pa.RecordBatch.from_pydict(one, pa.schema([("row", pa.int64()), ("at", pa.int32()), ("lead", pa.string()), ("body", pa.string()), ("trail", pa.string()), ("opened", pa.bool_()), ("within", pa.bool_())]))
                    opened = within

    return run


MAP_DDL = "row long, at int, moves array<long>"


def _flat(m: Map) -> list[int]:
    return [x for i, js in m.items() for j, n in js.items() for x in (*i, *j, n)]


def _maps(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Transducer(held.value)
        for b in batches:
            found = [_flat(t.transfer(*x)) for x in zip(*(b[c] for c in ("lead", "body", "trail", "opened", "within")), strict=True)]
            yield pd.DataFrame({"row": b["row"], "at": b["at"], "moves": found})

    return run


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring maps of a text as one."""
    rows, maps = rows.sort_values("at"), []
    for moves in rows["moves"]:
        m: Map = {}
        for p, e, q, f, n in np.asarray(moves).reshape(-1, 5).tolist():
            m.setdefault((p, e), {})[q, f] = n
        maps.append(m)
    return pd.DataFrame({"row": rows["row"].iloc[:1], "at": [int(rows["at"].iloc[0]) // BLOCK], "moves": [_flat(reduce(composed, maps))]})


def count(docs: DataFrame, tokenizer: Tokenizer, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    if chunk <= 4 * tokenizer.width:
        raise ValueError("a chunk must be longer than four tokens")
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    out = rows.where(~long).select("doc_id", _short(held)(F.col("text")).alias("p")).select("doc_id", "p.*")
    giant = stored(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "giants")
    if giant.take(1):
        parts = giant.select("row", "text").mapInArrow(_cut(held, chunk), "row long, at int, lead string, body string, trail string, opened boolean, within boolean")
        maps = parts.repartition("row", "at").mapInPandas(_maps(held), MAP_DDL)
        blocks = maps.groupBy("row", F.floor(F.col("at") / BLOCK)).applyInPandas(_compose, MAP_DDL)
        whole = blocks.groupBy("row").applyInPandas(_compose, MAP_DDL)
        # one map from the beginning to the end of the text is left: 0, 0, 0, 0, tokens
        counted = whole.select("row", F.element_at("moves", 5).alias("n_tokens"))
        out = out.unionByName(giant.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(counted, "row").drop("row"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

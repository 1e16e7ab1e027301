"""The prefix trie and the resampling, against brute force and DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from conftest import *  # noqa: F403
from oracle import SF
from test_operators import ALNUM, lower

from skyledger.llm import prefix_trie, queries, resampling

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck(sql):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


def brute(rows):
    """Nodes of the trie, from lists of turns."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = Counter(k[:-1] for k in members if k)
    out = set()
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n, copies):
    """Conversations with common turns, copies, gaps, nulls, ties and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in sorted(r.sample(range(3 * n), n)):
        for k in range(r.randint(1, 7)):
            rows.append((c, None if k == 0 and r.random() < 0.2 else k, r.choice(["user", "user", None, ""]), r.choice(["hi", "hi", "hi there", "", None, f"t {r.randrange(9)}"]), "clash", 1))
    for c in range(10_000, 10_000 + copies):
        rows += [(c, k, "user", f"the same {k}", "clash", 1) for k in range(6)]
    rows += [(77_777, 3, "user", "tie a", None, None), (77_777, 3, "user", "tie b", None, None), (77_777, 3, "user", "tie b", None, None), (None, 1, "user", "no id", None, None), (77_778, 1, "user", "w " * 50_000, None, None), (77_779, 1, "a", "bc", None, None), (77_780, 1, "ab", "c", None, None)]
    return rows


@pytest.mark.parametrize("size", [5, 100_000])
def test_trie(spark, size):
    """Few and many ranges, a group of copies over several of them."""
    rows = made(size, 300, 200)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(x) for x in prefix_trie.trie(table, size).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_trie_of_long_and_turnless_conversations(spark):
    takes = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]
    rows = [(takes[0], 1, "user", "one turn, and a block without a first conversation", None, None)]
    rows += [(40 + c, k, "u", f"{k if k < 400 else k + c}", None, None) for c in (1, 2, 3) for k in range(800)]
    got = [tuple(x) for x in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), 50).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_medians():
    assert sorted(prefix_trie.medians(10)) == list(range(10)) and next(prefix_trie.medians(9)) == 4 and not list(prefix_trie.medians(0))


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_importance_resampling"])
def test_same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, duck(queries.SQL[name])))


def ngrams(text, most):
    w = ALNUM.findall(lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, corpus, empty, most, monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 500)
    docs, _ = corpus
    target = docs.where("lang = 'de' and doc_id < 60").select("text")
    bucket = lambda x: zlib.crc32(x.encode()) % 1000
    rows = [(r.doc_id, *ngrams(r.text, most)) for r in docs.collect()]
    s, t = Counter(bucket(x) for *_, f in rows for x in f), Counter(bucket(x) for r in target.collect() for x in ngrams(r.text, most)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 1000) / ((s[b] + 1) * (t.total() + 1000))))
    want = []
    for i, n, f in rows:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted(((-x[3], x[0]) for x in want if x[4] >= 20 and x[0] is not None))
    drawn = Counter()
    for rank, (_, i) in enumerate(able[: len(able) // 4], 1):
        drawn[i] = rank
    got = resampling.resample(docs, target, resampling.Features(1000, most), seed=7, percent=25).collect()
    assert sorted(map(repr, (tuple(r[:4]) for r in got))) == sorted(map(repr, (x[:4] for x in want)))
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(able) // 4 + 1))
    assert {r.doc_id: r.rank for r in got if r.rank and r.doc_id != 305} == {i: k for i, k in drawn.items() if i != 305}
    # the target's language is drawn more often
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(lang[r.doc_id] == "de" for r in got if r.rank) > 0.5 * len(able) / 4
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)

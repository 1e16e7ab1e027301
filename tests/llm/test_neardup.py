"""Near-duplicates against brute force: clashing ids, and bands that need many blocks."""

import random

import pytest
from conftest import *  # noqa: F403
from test_operators import shingle_set

from skyledger.llm import neardup


def groups(sets):
    """Least member of each row's component, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [2, 7, 512])
def test_large_bands(spark, monkeypatch, block):
    """A chain of texts, each near to its neighbours only, and outliers near the limit; blocks of few rows give the same."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(60):
        texts.append(" ".join(base[k // 2 :] + [f"v{k // 2}-{i}" for i in range(k // 2)] + [f"x{k}"]))
    for _ in range(60):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(80)] = f"y{r.random()}"
        texts.append(" ".join(words))
    sets = [shingle_set(t) for t in texts]
    want = groups(sets)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in neardup.cluster(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert len(set(want)) > 1 and max(want.count(x) for x in want) > 20


def shared_passage(r, n, own):
    """n texts of a common passage of 100 words and own ones, and a near copy of every fifth."""
    passage = [f"p{i}" for i in range(100)]
    texts = []
    for k in range(n):
        words = passage + [f"o{k}-{i}" for i in range(own)]
        if k % 5 == 4:
            words = texts[-1].split()
            words[r.randrange(100, 100 + own)] = "changed"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("wide", "frequent"), [(4, 100), (4, 10), (8192, 100_000)])
def test_wide_bands(spark, monkeypatch, wide, frequent):
    """Bands of many unlike rows give the same links by prefixes, and few rows meet."""
    monkeypatch.setattr(neardup, "WIDE", wide)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    texts = shared_passage(random.Random(3), 150, 80)
    want = groups([shingle_set(t) for t in texts])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[7]) for i in range(200)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in neardup.cluster(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 120
    assert all(got[1000 + i] == 7 for i in range(200))


def test_clashing_ids(spark):
    """Two texts under one id are two documents; an id and text that repeat are one."""
    a, b, c = ("one two three four five six seven eight", "nothing alike in here at all my friend", "third text with other words in it too")
    rows = [(1, a, "x", 1), (1, b, "y", 2), (1, a, "z", 3), (2, a, "p", 4), (3, c, "q", 5), (3, c, "q", 5), (4, b, "r", 6), (0, c.upper(), "s", 7), (5, "", "t", 8), (5, None, "u", 9), (None, a, "v", 10), (1, a.replace(" ", "  "), "w", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, component long").repartition(2)
    got = sorted((-1 if x.doc_id is None else x.doc_id, -1 if x.component_id is None else x.component_id, x.n_shingles, x.kept) for x in neardup.cluster(docs).collect())
    assert got == sorted([(1, 1, 4, True), (1, 1, 4, True), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (3, 0, 4, False), (3, 0, 4, False), (4, 1, 4, False), (0, 0, 4, True), (5, 5, 0, True), (5, 5, 0, True), (-1, -1, 4, True)])
    kept = neardup.drop_copies(docs)
    assert kept.columns == docs.columns
    left = sorted((x.doc_id if x.doc_id is not None else -1, " ".join((x.text or "").split())) for x in kept.collect())
    assert left == sorted([(1, a), (1, b), (0, c.upper()), (5, ""), (5, ""), (-1, a)])


def test_hash_of_a_word_alone():
    """A word's hash is the same beside a very long word, and in another place."""
    import numpy as np

    h = lambda t: neardup.word_hashes(np.frombuffer(t, np.uint8))[0].tolist()
    long = b"x" * 9000
    assert h(b"one " + long + b" two") == [*h(b"ONE"), *h(long), *h(b"  two ")]
    assert h(long) != h(long[:-1] + b"y") and len(set(h(b"a b ab ba"))) == 4

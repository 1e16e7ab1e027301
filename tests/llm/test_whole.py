"""The whole job on cases that the brute-force tests of the operators do not hold."""

import math
import random
import re
import textwrap

import numpy as np
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from skyledger.llm import licenses, lmscore, pii, secrets


def test_ip_parts_of_zeros(spark):
    texts = ["at 10.0.0.1 now", "192.168.0.1", "127.0.0.1 and 1.2.3.00", "000.00.0.0", "0255.1.2.010", "256.0.0.1", "10.0.0.0256", "1.2.3.300", "0" * 3000 + ".0.0.1", "1.0.0." + "0" * 3000 + "256"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: [(s.start, s.end) for s in r.base if pii.KINDS[s.kind] == "ip"] for r in pii.base_spans(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [m.span() for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t) if all(int(x) <= 255 for x in m[0].split("."))], t
    assert pii.redact(docs, pii.fit(docs)).where("doc_id = 1").first().text == "[IP]"


def windows(text, template):
    """Most words of the template in a window, each window tried."""
    wanted, size = set(template.split()), math.floor(len(template.split()) / licenses.THRESHOLD)
    words = text.split()
    return max((len(wanted & set(words[a : a + size])) for a in range(len(words))), default=0)


def test_license_windows():
    known = licenses.Templates({w.encode(): n for n, w in enumerate("the of license under this".split(), 1)})
    labels = lambda t: licenses.judge(t.encode(), known)[5].split(",")
    for label, template in licenses.TEMPLATES:
        for width in (1, 20, 40, 60, 72, 79):
            for lead in ("", "some other words before it "):
                assert label in labels("\n".join(f" * {x}" for x in textwrap.wrap(lead + template, width, break_long_words=False))), (template, width)
    filler = " word" * 50
    assert labels(f"all{filler} rights{filler} reserved") == [""]
    assert labels(f"x{filler} all rights\nreserved{filler}") == ["proprietary"]
    assert labels(f"x{filler} all rights{filler} all reserved") == [""]
    # a long text of rare words takes linear time
    long = "the of license under this all rights " * 30_000
    assert licenses.judge(long.encode(), known)[0] == 210_000
    r = random.Random(3)
    for _ in range(300):
        label, template = r.choice(licenses.TEMPLATES)
        words = template.split()
        for _ in range(r.randint(0, 3)):
            words.insert(r.randrange(len(words)), r.choice(["zz", "the", "\n", "license", "under"]))
        if r.random() < 0.5:
            words.pop(r.randrange(len(words)))
        text = " ".join(["of", "the"] * r.randint(0, 4) + words + ["license", "\n", "this"] * r.randint(0, 3) + template.split()[:3])
        shares = {(x, t): windows(text, t) / len(set(t.split())) for x, t in licenses.TEMPLATES}
        got = licenses.judge(text.encode(), known)
        base = set(got[4].split(",")) - {""}
        assert set(got[5].split(",")) - {""} == base | {x for (x, _), s in shares.items() if s >= licenses.THRESHOLD - 1e-9}, text
        if not base:
            assert got[6] == max([s for s in shares.values() if s >= licenses.THRESHOLD - 1e-9], default=0.0)


def test_language_model_whatever_the_parts(spark, monkeypatch):
    """Scores don't depend on partitions, on the parts of the list, or on which words go to every task; beginnings are counted as a plain loop does."""
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 120))) for _ in range(60)] + ["ab" * 60 + " ab", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = []
    for parts, part, top in ((1, 1 << 15, 1 << 17), (7, 100, 30)):
        monkeypatch.setattr(lmscore, "PART", part)
        monkeypatch.setattr(lmscore, "TOP", top)
        rows = docs.repartition(parts)
        scores.append({x.doc_id: x.score for x in lmscore.score(rows, lmscore.fit(rows)).collect()})
    assert all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-9) for i in range(len(texts)))
    assert scores[0][61] == scores[0][62] and all(v < 0 for v in scores[0].values())
    words = sorted({w.encode() + b" " for t in texts if t for w in t.split()})
    n = np.array([[r.randint(1, 9)] + [0] * (lmscore.CLASSES - 1) for _ in words])
    spelling = lmscore.Spelling.of(lmscore.pa.array(words, lmscore.pa.binary()))
    at, both, one, source = lmscore.beginnings(spelling, n, {})
    for k in r.sample(range(len(words)), 40):
        w = words[k]
        for j in range(min(len(w), lmscore.DEPTH)):
            i = source[spelling.ends[k] + j]
            for d in range(8):
                alike = [m for m, x in enumerate(words) if len(x) > j and x[:j] == w[:j] and x[j] >> (8 - d) == w[j] >> (8 - d)]
                assert both[i, d, 0] == n[alike].sum() and one[i, d, 0] == sum(n[m].sum() for m in alike if words[m][j] >> (7 - d) & 1)


def test_long_texts_alone_teach_the_mixer(spark):
    """Runs of texts of every length are the sample; words at the cuts are left out."""
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(6000)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], "x" * 20_000, "", None])), "doc_id long, text string")
    rows = docs.select("text")
    sample = lmscore._sample(rows, 10, 2000)
    words = {w for t in texts for w in t.split()}
    assert 3 <= len(sample) <= 40 and all(len(x) <= 12_000 for x, _ in sample)
    assert {w for x, _ in sample for w in x.decode().split()} - {"x" * 20_000} <= words
    assert sorted(sample) == sorted(lmscore._sample(rows.repartition(5), 10, 2000))
    every = lmscore._sample(rows, 10**6, 2000)
    assert sum(last for _, last in every) == 5 and sum(len(x.split()) for x, _ in every) > 0.98 * 24_000
    model = lmscore.fit(docs, sample_runs=10, sample_size=2000)
    assert any((a != b).any() for a, b in zip(model.mixer.weights, lmscore.Mixer.even().weights, strict=True))


def test_all_occurrences_teach_the_mixer(spark, monkeypatch):
    """However small the sample, the table counts every choice of every training word, and the weights' step is that of a plain loop over the words."""
    r = random.Random(12)
    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 90))) for _ in range(50)] + ["x" * 50, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept, own = {}, lmscore._taught
    monkeypatch.setattr(lmscore, "PART", 60)
    monkeypatch.setattr(lmscore, "_taught", lambda mixer, counts, *a: own(*kept.setdefault("in", (mixer, counts)), *a))
    model = lmscore.fit(docs, sample_runs=2, sample_size=200)
    assert model.mixer.refined.sum() == 8 * sum(len(w) + 1 for t in texts for w in [*(t or "").split(), "."])
    words = {bytes(x.word): [x[c] for c in lmscore.COUNTS] for x in model.words.collect()}
    (mixer, counts), want = kept["in"], lmscore.Lesson.none()
    for w, n in words.items():
        both = np.zeros((len(w), 8, lmscore.CLASSES))
        one = both.copy()
        for j in range(min(len(w), lmscore.DEPTH)):
            for d in range(8):
                for v, m in words.items():
                    if len(v) > j and v[:j] == w[:j] and v[j] >> (8 - d) == w[j] >> (8 - d):
                        both[j, d] += m
                        one[j, d] += np.array(m) * (v[j] >> (7 - d) & 1)
        for c in np.flatnonzero(n):
            pick = lambda a: np.stack([a.sum(2), a[..., c]], 2)
            x, gates, bit = lmscore._seen(mixer, counts, w, sum(n), pick(both), pick(one))
            want.add(mixer, x, gates, bit, np.full(len(w), n[c]))
    assert np.abs(want.refined - model.mixer.refined).sum() <= 0.01 * want.refined.sum()  # hashed log-odds are rounded
    for w, new, s, b in zip(mixer.weights, model.mixer.weights, want.slopes, want.bends, strict=True):
        step = np.linalg.solve(b + np.eye(lmscore.INPUTS), s[..., None])[..., 0]
        assert np.abs(step).max() > 0.1 and np.allclose(new, w + step, atol=0.02)


def test_all_documents_move_the_centres(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.5, r.integers(1, 80)) % 500) for _ in range(90)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    middles = lmscore.centres(np.abs(r.normal(size=(40, lmscore.BUCKETS))))
    got = lmscore._moved(rows, middles)
    assert (got == lmscore._moved(rows.repartition(7), middles)).all()
    x = np.concatenate([lmscore.bags(lmscore.tokens([(t or "").encode()])[0], np.zeros(len((t or "").split()), int), 1) for t in texts])
    own = (x @ middles.T).argmax(1)
    for c in range(lmscore.CLASSES):
        total = x[own == c].sum(0)
        want = total / np.sqrt((total**2).sum()) if total.any() else middles[c]
        assert np.allclose(got[c], want, atol=1e-6)


def test_pii_written_another_way(spark):
    """Forms that no fixed pattern takes are found with full recall, and numbers of other make are left alone."""
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(body + c))) % 10 == 0)

    rows = []
    for i in range(400):
        name, a, b, c = f"n{digits(3)}", digits(3), digits(3), digits(4)
        rows.append((i, f"some words +1 ({a}) {b}-{c} more {name}@example.com and {card()} end, order {digits(8)} of {digits(4)}.{digits(4)}"))
    rows += [(i, f"words ({digits(3)}) {digits(3)}-{digits(4)} more") for i in range(1000, 1020)]
    rows += [(i, f"more joe{digits(2)} (at) example (dot) org end") for i in range(1020, 1040)]
    rows += [(i, f"ordered {digits(8)} of {digits(4)}.{digits(4)} there") for i in range(1040, 1060)]
    rows += [(2000, None), (2001, ""), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(docs, model)).collect()}
    texts = dict(rows)
    for i in range(1000, 1040):
        assert got[i].startswith("other:") and "," not in got[i]
        start, end = map(int, got[i].split(":")[1:])
        assert texts[i][start:end].count(" ") == len(texts[i].split()) - 3
    assert not any(got[i] for i in range(1040, 1060)) and got[2000] == got[2001] == ""
    assert sum("other" in got[i] for i in range(400)) == 0


def plain_candidates(text):
    """Runs of 12 or more, cut at sensitive words, that lie within NEAR of one."""
    words = [m.span() for m in secrets.SENSITIVE.finditer(text)]
    cut = list(text)
    for a, e in words:
        cut[a:e] = " " * (e - a)
    return [m.span() for m in secrets.CANDIDATE.finditer("".join(cut)) if any(0 <= m.start() - e <= secrets.NEAR or 0 <= a - m.end() <= secrets.NEAR for a, e in words)]


def test_secret_candidates_by_brute_force():
    r = random.Random(8)
    for _ in range(3000):
        parts = [r.choice(["token", "secret", " ", "\n", ": ", "é ", "a" * r.randint(1, 30), "Zk4" * r.randint(1, 40), "x y " * r.randint(1, 25)]) for _ in range(r.randint(0, 14))]
        text = "".join(parts)
        assert list(secrets.candidates(text)) == plain_candidates(text), repr(text)


def test_limits_of_all_ordinary_runs(spark):
    """Limits are those of a plain loop over every ordinary run, more than 4,000 here."""
    r = random.Random(12)
    mixed = lambda: "".join(r.choice("abcdefgh0123") for _ in range(r.randint(12, 30))) + "9z"
    word = lambda: "".join(r.choice(["und", "ent", "zach", "ver", "chbe", "ein"]) for _ in range(5))
    texts = [" ".join([mixed(), mixed(), word(), "plain"] * 2) for _ in range(1500)] + ["the token is " + "q7" * 9, None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    model = secrets.fit(docs)
    runs = {}
    for t in texts[:1500]:
        for m in secrets.CANDIDATE.finditer(t):
            one = t[max(0, m.start() - 200) : m.end() + 200], min(m.start(), 200)
            runs[m[0]] = min(runs.get(m[0], one), one)
    assert len(runs) > 4000 and len(model.names) > 1000
    costs, full = {}, secrets.Novelty(model)
    for run, (around, at) in runs.items():
        by = secrets.Novelty(secrets.Model(tuple(x for x in model.names if x != run), model.lines)) if run in model.names else full
        costs.setdefault(secrets.shape(run), []).append(by.cost(around, at, at + len(run)))
    want = [math.inf, secrets.COST, secrets.COST]
    for k, own in costs.items():
        want[k] = max(secrets.COST, math.nextafter(sorted(own, reverse=True)[len(own) // secrets.ORDINARY], math.inf))
    assert model.limits == tuple(want)


def test_novel_strings(spark, empty):
    """Random strings near sensitive words are found; the corpus's names, known or not, mostly are not."""
    r = random.Random(9)
    part = lambda: r.choice(["user", "order", "index", "cache", "table", "worker", "batch", "query", "node", "stream", "filter", "merge"])
    name = lambda: "_".join(part() for _ in range(r.randint(3, 4)))
    rows = [(i, " ".join(name() for _ in range(20))) for i in range(150)]
    rows += [(i, "".join(r.choice("0123456789") for _ in range(16))) for i in range(200, 600)]
    rows += [(i, "".join(r.choice(["und", "ent", "zach", "ver", "chbe", "ein", "zu", "sch"]) for _ in range(4))) for i in range(600, 900)]
    rows += [(None, None), (999, ""), (999, "")]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    again = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert model == again and len(model.names) > 100 and secrets.fit(empty) == secrets.Model()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = false = 0
    texts = []
    for i in range(200):
        key = "".join(r.choice(letters) for _ in range(24))
        texts.append((i, [f"the bearer is {key} here", f"{key} is our credential", f"the passphrase\nfollows {key}"][i % 3], key))
    texts += [(1000 + i, f"the bearer is {name()} here", "") for i in range(200)]
    # ordinary words, names and numbers beside the same words
    texts += [(3000 + i, f"the bearer is {x} here", "") for i, x in enumerate(["undentzachver", "enstchbeeinzu", "7534784127813050", "186661156000", "2024-01-01", "1234567890123456"])]
    texts += [(2000, "bearer " * 20000 + "Zk4v" * 5000, ""), (2001, None, ""), (2002, "", "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, spans string")
    for row in docs.select("doc_id", "text", F.col("spans").alias("key"), secrets.scan(docs, model=model).alias("p")).collect():
        spans = [x.split(":") for x in row.p.spans.split(",") if x.startswith("novel")]
        if row.doc_id >= 3000:
            assert not spans, row
        elif row.doc_id < 1000:
            found += [row.text[int(a) : int(e)] for _, a, e in spans] == [row.key]
        elif row.doc_id < 2000:
            false += len(spans)
        else:
            assert not spans
    assert found >= 180 and false <= 10
    assert empty.select(secrets.scan(empty, model=model)).count() == 0

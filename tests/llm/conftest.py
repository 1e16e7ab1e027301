import random
import zlib

import pytest

SYLLABLES = {"en": "the an er ing on st re nd ou ha".split(), "de": "sch ein ung ch keit ü ge ver zu ß".split(), "fr": "é eau oi que ç ment tre è la ou".split()}
RUDE = ["idiot", "moron", "scum", "worthless"]


def word(r, lang):
    return "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3)))


def prose(r, lang, n):
    return " ".join(word(r, lang) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, odd rows, repeated rows, clashing extra columns and labels."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        words = prose(r, lang, r.randint(60, 160)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(RUDE))
        rows.append((i, " ".join(words), lang, "src0"))
        labels.append((i, 1, int(toxic)))
    for i in range(240, 300):  # near copies of a few
        words = rows[i % 7][1].split()
        words[r.randrange(len(words))] = "zzz"
        rows.append((i, " ".join(words), rows[i % 7][2], "src1"))
    rows += [(300, None, None, None), (301, "", "en", "s"), (302, " \t\n ", "en", "s"), (303, "123 !!", "en", "s"), (304, "x" * 30000, "en", "s"), (None, "no id here but words", "en", "s"), (305, "again and again " * 40, "en", "s"), (305, "again and again " * 40, "en", "s")]
    docs = spark.createDataFrame([(*x, "clash", 1.0) for x in rows], "doc_id long, text string, lang string, source string, score string, kept double").repartition(3).cache()
    labels = spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int").cache()
    return docs, labels


@pytest.fixture(scope="session")
def empty(spark, corpus):
    return spark.createDataFrame([], corpus[0].schema)


def crc(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of

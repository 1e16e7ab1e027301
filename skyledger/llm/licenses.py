"""License notices by an exact set-similarity join of text windows with templates.

A window is a run of words of a text, whatever the lines, at most the template's number of words
over THRESHOLD long. A template is contained in a window that has at least THRESHOLD of its distinct
words. Words are ordered by how many documents of the corpus have them, rarest first. A window that
contains a template has one of its rarest words (prefix filter), so only runs of words within a
window's length of one are looked at. A run must be long enough (length filter), and enough of the
template's words must stand in reach (positional filter). In what is left all windows are counted
in full, so none is missed.

Templates are whole license texts and the notices that name a license. Null and empty texts have no
words and no labels, and an empty table no frequencies, which are then in alphabetical order, as
ties are. Rows are judged one by one, so repeated rows get equal results; other columns are not
read. Very long texts are taken whole, in linear time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import concat_structs, struct_of

THRESHOLD = 0.8
# Phrases that name a license, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Usual notices, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved"),
]
# Whole license texts and the notices that go with them, by label, in words.
TEXTS = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited
to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("bsd", """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the
use of this software even if advised of the possibility of such damage"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
notice and this permission notice appear in all copies"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the
license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as
is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free
software foundation either version 2 1 of the license or at your option any later version"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain
one at https mozilla org mpl 2 0"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
]
TEMPLATES = [*TEMPLATES, *[(label, " ".join(text.split())) for label, text in TEXTS]]
#: Bytes of words to themselves, A-Z in lower case, all others to a space.
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


class Templates:
    """The templates with their words in global order and an index of their prefixes."""

    def __init__(self, frequency: dict[bytes, int], templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD):
        given = TEMPLATES if templates is None else templates
        words = sorted({w for _, t in given for w in t.encode().split()}, key=lambda w: (frequency.get(w, 0), w))
        #: Of each template: label, distinct words, how many a window needs, and its longest window.
        self.sets: list[tuple[str, frozenset[bytes], int, int]] = []
        #: The templates that have a word in their prefix.
        self.index: dict[bytes, list[int]] = {}
        for k, (label, text) in enumerate(given):
            own = frozenset(text.encode().split())
            need = math.ceil(round(threshold * len(own), 9))
            self.sets.append((label, own, need, math.floor(round(len(text.split()) / threshold, 9))))
            for w in [w for w in words if w in own][: len(own) - need + 1]:
                self.index.setdefault(w, []).append(k)
        self.first = frozenset(self.index)

    def contained(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Labels and best shares of the templates that a window of the words contains."""
        reach: dict[int, list[list[int]]] = {}
        for p, w in enumerate(words):
            for k in self.index.get(w, ()):
                size = self.sets[k][3]
                runs = reach.setdefault(k, [])
                if runs and p - size + 1 <= runs[-1][1]:
                    runs[-1][1] = min(p + size, len(words))
                else:
                    runs.append([max(p - size + 1, 0), min(p + size, len(words))])
        found = []
        for k, runs in reach.items():
            label, own, need, size = self.sets[k]
            best = 0
            for lo, hi in runs:
                if hi - lo < need:  # length
                    continue
                at = [p for p in range(lo, hi) if words[p] in own]
                if len({words[p] for p in at}) >= need:  # positions
                    best = max(best, self._most(words, at, size))
            if best >= need:
                found.append((label, best / len(own)))
        return found

    @staticmethod
    def _most(words: list[bytes], at: list[int], size: int) -> int:
        """The most different words in a window, from the places of the words that count."""
        count: Counter = Counter()
        best, end = 0, 0
        for p in at:
            while end < len(at) and at[end] < p + size:
                count[words[at[end]]] += 1
                end += 1
            best = max(best, len(count))
            count[words[p]] -= 1
            if not count[words[p]]:
                del count[words[p]]
        return best


def frequencies(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None) -> dict[bytes, int]:
    """For each word of a template, how many documents have it; counted over all documents."""
    words = frozenset(w for _, t in (TEMPLATES if templates is None else templates) for w in t.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t:
                    n.update(words.intersection(t.translate(LETTERS).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def _phrases(words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
    """Count, first and last start, and labels of the phrases."""
    line, n, first, last, labels = b" " + b" ".join(words) + b" ", 0, None, None, set()
    for phrase, label in PHRASES.items():
        wanted, at, word, done = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(wanted, at + 1)) >= 0:
            word, done = word + line.count(b" ", done, at), at
            n += 1
            labels.add(label)
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
    return n, first, last, labels


def judge(text: bytes | None, templates: Templates) -> tuple:
    """The values of FIELDS for one text."""
    clean = (text or b"").translate(LETTERS)
    words = clean.split()
    n, first, last, base, more, score = 0, None, None, set(), set(), 0.0
    if b"license" in clean or b"cc" in clean:
        n, first, last, base = _phrases(words)
    if not templates.first.isdisjoint(words):
        for label, share in templates.contained(words):
            more.add(label)
            score = max(score, share)
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else score


def scan(docs: DataFrame, templates: Templates, text: str = "text") -> Column:
    """A column of the struct in SCHEMA for a text column of docs."""
    held = docs.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [judge(t, held.value) for t in batch.cast(pa.binary()).to_pylist()]
            yield concat_structs([struct_of(FIELDS, list(zip(*rows, strict=True)))] if rows else [], FIELDS)

    return F.arrow_udf(run, SCHEMA)(F.col(text).cast("string"))

"""License scans: matching statistics of a generalised suffix automaton of license texts, chained into spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

# Phrases that are a match by themselves, and well-known license wordings, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License. See the LICENSE file for details.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
}
#: Least words of a match that is chained, words that a chain may skip on either side between two matches, the share of a
#: template that a chain must cover for its label.
LEAST, SKIP, COVERED = 4, 6, 0.6


class Automaton:
    """Generalised suffix automaton over word keys; each state knows all places where its strings end in each template."""

    def __init__(self, texts: list[np.ndarray]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        last_of = []
        for number, words in enumerate(texts):
            last = 0
            for at, word in enumerate(words.tolist()):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, set()).add(at + 1)
            last_of.append(last)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:  # a state's shorter strings end where its longer ones do
            for number, places in self.ends[v].items():
                self.ends[self.link[v]].setdefault(number, set()).update(places)
        self.whole = {v: [k for k, x in enumerate(last_of) if x == v] for v in set(last_of)}
        keys = [x for t in texts for x in t.tolist()]
        self.words = np.array(sorted(set(keys)), np.uint64)
        pairs = {(self.number(a), self.number(b)) for t in texts for a, b in zip(t[:-1], t[1:], strict=True)}
        self.pairs = np.zeros((len(self.words) + 1,) * 2, bool)
        for a, b in pairs:
            self.pairs[a, b] = True

    def number(self, key: int) -> int:
        return int(np.searchsorted(self.words, key)) + 1

    def _new(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(next_)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word the state and length of the longest suffix that the texts hold."""
        v = n = 0
        for c in words:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n

    def endings(self, v: int, n: int) -> Iterator[int]:
        """Texts that are, whole, a suffix of the n words matched in state v: a state's text is its longest string."""
        while v > 0:
            if v in self.whole and n >= self.length[v]:
                for k in self.whole[v]:
                    yield k
            v = self.link[v]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        pairs = [(x, label) for x, label in phrases.items()] + [(x, label) for label, texts in templates.items() for x in texts]
        self.n_phrases = len(phrases)
        self.labels = [label for _, label in pairs]
        self.texts = [common.word_keys(x) for x, _ in pairs]
        self.automaton = Automaton(self.texts)
        self.size = [len(x) for x in self.texts]

    def scan(self, col: pa.Array) -> list[dict]:
        """For each row: words, places of phrases, and chains as (label, first word, end word, share covered)."""
        w = common.Words(col)
        a = self.automaton
        at = np.minimum(np.searchsorted(a.words, w.key), len(a.words) - 1)
        number = np.where(a.words[at] == w.key, at + 1, 0)
        follows = a.pairs[number[:-1], number[1:]] if len(number) else np.zeros(0, bool)
        inner = w.first[1:-1]
        inner = inner[(inner > 0) & (inner < len(number))]
        follows[inner - 1] = False  # a match of two words or more needs each pair of neighbours; none spans two rows
        edge = np.flatnonzero(np.diff(np.concatenate([[0], follows.astype(np.int8), [0]])))
        row_of = np.searchsorted(w.first, edge[::2], "right") - 1
        out = [{"n_words": int(n), "base": [], "runs": []} for n in w.counts]
        for row, begin, end in zip(row_of.tolist(), edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
            if end - begin < 3:
                continue
            zero, state = int(w.first[row]), None
            found = out[row]
            for place, (v, n) in enumerate(a.stream(w.key[begin:end].tolist()), begin - zero + 1):
                for k in a.endings(v, n):
                    if k < self.n_phrases:
                        found["base"].append((place - self.size[k], self.labels[k]))
                if state and n <= state[1]:  # the former match could not be made longer
                    found["runs"].append(state)
                state = (place, n, v)
            found["runs"].append(state)
        for found in out:
            found["chains"] = self.chain([x for x in found.pop("runs") if x and x[1] >= LEAST])
        return out

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches (end, length, state) that go on in a template within SKIP words of where they stopped.

        A match that stands at several places of a template goes on with the chain that it fits best at each, and begins
        one where it fits none. Of chains of one template over the same words the one that covers most is kept.
        """
        open_: dict[int, list[list[int]]] = {}
        done: dict[int, list[list[int]]] = {}
        for end, n, v in runs:
            for k, stops in self.automaton.ends[v].items():
                if k < self.n_phrases or self.size[k] < LEAST:
                    continue
                chains, live = done.setdefault(k, []), []
                for x in open_.get(k, ()):  # matches begin later and later, so what lies too far back stays so
                    (live if end - n - x[1] <= SKIP else chains).append(x)
                open_[k] = live
                for stop in sorted(stops):
                    fit = [x for x in live if x[1] < end and abs(stop - n - x[3]) <= SKIP]
                    fresh, last = max(((min(n, stop - x[3], end - x[1]), x) for x in fit), key=lambda y: (y[0], y[1][2]), default=(0, None))
                    if fresh > 0:
                        last[1], last[2], last[3] = end, last[2] + fresh, stop
                    elif not fit:
                        live.append([end - n, end, n, stop])
        out = []
        for k, chains in ((k, done[k] + open_[k]) for k in open_):
            kept: list[list[int]] = []
            for x in sorted(chains, key=lambda x: (-x[2], x[0])):
                if x[2] >= COVERED * self.size[k] and all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                    kept.append(x)
            out += [(self.labels[k], x[0], x[1], x[2] / self.size[k]) for x in kept]
        return sorted(out)


SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,stop:long,covered:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: places of phrases, labels of phrases and of covered templates, spans, score.

    The score is 1 with a phrase, else the largest share of a template that a chain covers, else 0. Null and empty
    texts have no words, no labels (empty strings) and score 0; repeated rows each count, ties of chains go to the earlier;
    an empty table gives no rows; other columns don't count.
    """
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(SPAN))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.chunks(texts):
                rows = []
                for doc, x in zip(batch.column(0).slice(a, b - a).to_pylist(), scanner.scan(texts.slice(a, b - a)), strict=True):
                    places, base = [p for p, _ in x["base"]], {label for _, label in x["base"]}
                    labels = base | {c[0] for c in x["chains"]}
                    score = 1.0 if base else max((min(1.0, c[3]) for c in x["chains"]), default=0.0)
                    spans = [dict(zip(("label", "first", "stop", "covered"), c, strict=True)) for c in x["chains"]]
                    rows.append((doc, x["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(run), SCHEMA)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))

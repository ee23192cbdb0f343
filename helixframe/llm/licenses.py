"""License scans by a generalised suffix automaton of licence tokens.

Templates' words become one automaton, which is small and goes to every task. Words of each document stream through it
and give matching statistics: at each word, the longest stretch ending there that some template has. On the suffix-link
path of that state stand the other templates, and the other places of one, that share a shorter part of the stretch.
Stretches of LONG words or more that go on no further are matches. Matches of a template are chained in the order of the
template: each one begins and ends behind the last in the document and in the template alike, and only new words of both
count. A template's label counts if a chain covers enough of it. The base phrases are strings of the same automaton: a
phrase ends where its state lies on the suffix-link path of the current one.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import Vocabulary, Words, map_batches, pieces, without, words_of

#: Base phrases and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates of the method's own: licences and their notices as published, and common sentences that name one.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
)
#: Words of a match that counts as long; words of the document that may lie between chained matches; share of a template
#: to be covered.
LONG, GAP, COVERED = 3, 4, 0.85


class Automaton:
    """A suffix automaton of several token strings. places: for each state where its stretch ends, (string, end), end
    exclusive. prefixes: the state of each prefix of each string."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for tokens in strings:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        self.prefixes: list[list[int]] = []
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for k, tokens in enumerate(strings):
            state, own = 0, []
            for n, t in enumerate(tokens):
                state = self.next[state][t]
                own.append(state)
                for up in self.path(state):
                    self.places[up].add((k, n + 1))
            self.prefixes.append(own)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            q = self.next[last][t]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, t)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
        return new

    def _split(self, p: int, q: int, t: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def path(self, state: int) -> list[int]:
        out = []
        while state > 0:
            out.append(state)
            state = self.link[state]
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        words = words_of([x for x, _ in phrases] + [x for _, x in templates])
        self.vocabulary = Vocabulary(words)
        self.strings = [x.tolist() for x in np.split(self.vocabulary.numbers, words.first[1:-1])]
        self.auto = Automaton(self.strings)
        self.base, self.labels = len(phrases), [x for _, x in phrases] + [x for x, _ in templates]
        self.sizes = [len(x) for x in self.strings]
        whole: dict[int, list[int]] = {}
        for k in range(self.base):
            if self.strings[k]:
                whole.setdefault(self.auto.prefixes[k][-1], []).append(k)
        # For each state the base phrases on its suffix-link path, and the places of templates.
        self.phrases = [[k for s in self.auto.path(state) for k in whole.get(s, ())] for state in range(len(self.auto.next))]
        self.shortest = min([LONG, *[n for n in self.sizes[: self.base] if n]])
        self.places = [sorted(x for x in found if x[0] >= self.base) for found in self.auto.places]

    def endings(self, state: int, length: int) -> list[tuple[int, int, int]]:
        """(template, end, words): every place of a template where LONG words or more that end here stand, with as many
        of them as do."""
        out, known = [], set()
        while state > 0 and length >= LONG:
            for place in self.places[state]:
                if place not in known:
                    known.add(place)
                    out.append((*place, length))
            state = self.auto.link[state]
            length = self.auto.length[state]
        return out

    def scan(self, tokens: list[int], offset: int, places: list, matches: list) -> None:
        """A stretch of known words: adds (start, phrase) and matches (end, end in the template, words, template), ends exclusive."""
        auto, state, length = self.auto, 0, 0
        moves, link, lengths = auto.next, auto.link, auto.length
        last = len(tokens) - 1
        for k, t in enumerate(tokens):
            while state and t not in moves[state]:
                state = link[state]
                length = lengths[state]
            if t in moves[state]:
                state = moves[state][t]
                length += 1
            else:
                length = 0
            for p in self.phrases[state]:
                if length >= self.sizes[p]:
                    places.append((offset + k + 1 - self.sizes[p], p))
            if length >= LONG:
                after = tokens[k + 1] if k < last else -1
                for o, end, n in self.endings(state, length):
                    own = self.strings[o]
                    if end == len(own) or own[end] != after:  # else it goes on with the next word
                        matches.append((offset + k + 1, end, n, o))

    def chained(self, matches: list) -> list[tuple[int, int, int, float]]:
        """(start, end, template, share covered) of chains of a template's matches that cover enough of it. Of chains
        that share words of the document the one of most words counts, then the first."""
        out = []
        for o in sorted({m[3] for m in matches}):
            own = sorted(m[:3] for m in matches if m[3] == o)
            need = COVERED * self.sizes[o]
            #: Most words covered by a chain that ends with each match; where it begins.
            best, first, low = [], [], 0
            for k, (b, e, n) in enumerate(own):
                best.append(n)
                first.append(b - n)
                for j in range(k - 1, -1, -1):
                    c, f, m = own[j]
                    if c < b - self.sizes[o] - GAP:
                        break
                    if c < b and f < e and c - m < b - n and f - m < e - n and c + GAP >= b - n:
                        new = min(n, b - c, e - f)
                        if best[j] + new > best[k] or best[j] + new == best[k] and first[j] > first[k]:
                            best[k], first[k] = best[j] + new, first[j]
            starts: list[int] = []  # of chains taken so far, in order, and their ends
            ends: list[int] = []
            for k in sorted((k for k in range(len(own)) if best[k] >= need), key=lambda k: (-best[k], own[k][0], -first[k])):
                a, b = first[k], own[k][0]
                at = bisect_right(starts, a)
                if (not at or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
                    starts.insert(at, a)
                    ends.insert(at, b)
                    out.append((a, b, o, min(1.0, best[k] / self.sizes[o])))
        return sorted(out)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs with n_words, places (start, label: base phrases, words from 0), spans (start, end, label: covered template
    spans, end exclusive) and score (the largest share of a template or phrase that was covered; 0 without any).

    Null and empty texts have no words. Rows that repeat are each scanned; other columns pass through, but for
    those that have one of the four names, which are replaced. Texts of any length are scanned whole, however often a template comes in
    one. No documents give no rows.
    """
    docs = without(docs, "n_words", "places", "spans", "score")
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)), T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType())])
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]

    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for part, data, at in pieces(batch):
                words = Words(data, at)
                known = scanner.vocabulary.find(words)
                inside = known >= 0
                border = np.zeros(len(known) + 1, bool)
                border[words.first] = True
                first = np.flatnonzero(inside & (border[:-1] | ~np.concatenate(([False], inside[:-1]))))
                last = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
                long = last - first >= scanner.shortest
                places: list[list] = [[] for _ in range(part.num_rows)]
                matches: list[list] = [[] for _ in range(part.num_rows)]
                for a, b, r in zip(first[long].tolist(), last[long].tolist(), words.row[first[long]].tolist(), strict=True):
                    scanner.scan(known[a:b].tolist(), a - int(words.first[r]), places[r], matches[r])
                chains = [scanner.chained(x) if x else [] for x in matches]
                labels = scanner.labels
                score = [max([1.0] * bool(p) + [c[3] for c in x], default=0.0) for p, x in zip(places, chains, strict=True)]
                columns = [
                    pa.array(words.counts, pa.int64()), pa.array([[{"start": a, "label": labels[p]} for a, p in sorted(x)] for x in places], kinds[0]),
                    pa.array([[{"start": a, "end": b, "label": labels[o]} for a, b, o, _ in x] for x in chains], kinds[1]), pa.array(score, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "n_words", "places", "spans", "score"])

    return map_batches(docs, run, schema)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base, own = F.transform("places", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, own)).alias("labels"), "score",
    )


def op5_licenses_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op5_licenses that base phrases alone give, which SQL has too."""
    return op5_licenses(spark, sf_dir).drop("labels", "score")


#: Phrases as strings of words between borders, found by cutting them out one word at a time.
OP5_BASE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT * FROM (VALUES {", ".join(f"(string_split('{x}', ' '), '{label}')" for x, label in PHRASES)}) t(p, label)),
f AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM d, p),
g AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (r)
"""

"""Operator 10: licence scans with a generalised suffix automaton.

The automaton holds the words of every licence template. A text's words stream through it and leave at each place
the length of the longest template passage that ends there (matching statistics). Long matches of one template that
follow each other, in the text and in the template, chain into a covered span; a template counts as found where its
chain covers enough of it. Phrases are templates too: a phrase stands where its own state is a suffix of the match.

Most words stand in no template and reset the match, so only runs of template words are walked.

Defined results: a null or wordless text has no words, no places, null first_word and last_word, empty labels, score 0;
each row is judged alone, so repeated rows get the same result each; further columns are ignored; an empty table gives
an empty table; a long text comes alone, as arrays of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, chunks, hash_bytes, is_word, lowered, only, prefix_hash, span_hash, spans, table, utf8

#: Phrases, of which every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public licences and usual notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-short": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3-short": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-short": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


def full_texts() -> dict[str, str]:
    """The licences in the folder ``licences`` beside this file, whole, by the names of their files."""
    return {f"{f.stem}-text": f.read_text() for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))}


#: A match is long from so many words on, or over the whole of a shorter template; a chain may skip so many words.
LONG, GAP = 4, 6
#: The share of a template that a chain has to cover.
COVERED = 0.7
_LETTER = is_word((*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))


def words_of(text: str) -> list[bytes]:
    data = lowered(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = spans(_LETTER[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


class Automaton:
    """Generalised suffix automaton of sequences of word ids."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: A place (sequence, end) of each state's longest passage.
        self.at: list[tuple[int, int]] = [(-1, -1)]
        self.sequences = sequences
        for k, words in enumerate(sequences):
            last = 0
            for i, word in enumerate(words):
                last = self._add(last, word, (k, i))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.link]
        for k, words in enumerate(sequences):
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                self.ends[state].add((k, i))
        for s in order:
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _new(self, length: int, link: int, moves: dict[int, int], at: tuple[int, int]) -> int:
        self.next.append(dict(moves))
        self.link.append(link)
        self.length.append(length)
        self.at.append(at)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], self.next[q], self.at[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, word: int, at: tuple[int, int]) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1, 0, {}, at), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the longest passage that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.names = [*phrases.values(), *templates]
        self.texts = [words_of(t) for t in (*phrases, *templates.values())]
        self.phrases = len(phrases)
        vocabulary = sorted({w for t in self.texts for w in t})
        hashes = np.array([hash_bytes(w) for w in vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = Automaton([[number[w] for w in t] for t in self.texts])
        self.phrase_state = {}
        for k in range(self.phrases):
            state = 0
            for w in self.texts[k]:
                state = self.automaton.next[state][number[w]]
            self.phrase_state[k] = state
        #: Words of the shortest run that may hold a phrase or a match.
        self.least = 1 if any(len(t) == 1 for t in self.texts[: self.phrases]) else 2
        self.known: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        #: A phrase ends wherever its own state is the match's state or a suffix link of it.
        self.phrase_at = []
        for s in range(len(self.automaton.link)):
            chain, t = set(), s
            while t > 0:
                chain.add(t)
                t = self.automaton.link[t]
            self.phrase_at.append([k for k, p in self.phrase_state.items() if p in chain])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the templates, -1 of others."""
        where = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[where] == hashes, self.order[where], -1)

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """(places (phrase, start), spans (label, first word, last word, share covered)) of one text's word ids."""
        inside = ids >= 0
        starts, ends, _ = spans(inside, np.array([0, len(ids)]))
        places, ended = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < self.least:
                continue
            before = (0, 0)
            for i, (state, length) in enumerate(self.automaton.statistics(ids[a:b].tolist()), a):
                for k in self.phrase_at[state]:
                    if length >= len(self.texts[k]):
                        places.append((k, i - len(self.texts[k]) + 1))
                if length <= before[1]:
                    ended.append((i - 1, *before))
                before = (state, length)
            ended.append((b - 1, *before))
        return places, self.chains([e for e in ended if e[2] >= 2])

    def ends_of(self, state: int) -> tuple[int, list[tuple[int, int]]]:
        """(words that a match must have for any of them, (template, end) of the state's passages in order)."""
        if state not in self.known:
            ends = sorted(x for x in self.automaton.ends[state] if x[0] >= self.phrases)
            self.known[state] = (min((min(LONG, len(self.texts[k])) for k, _ in ends), default=1 << 30), ends)
        return self.known[state]

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """matches: (last word, state, length), maximal to the right, in the text's order."""
        open_: dict[int, list[list[int]]] = {}
        closed: list[tuple[int, int, int, int]] = []
        for last, state, length in matches:
            least, ends = self.ends_of(state)
            for k, end in ends if length >= least else ():
                if length < min(LONG, len(self.texts[k])):
                    continue
                first, start = last - length + 1, end - length + 1
                for chain in open_.setdefault(k, []):
                    # chain: first word, last word, last template word, words covered
                    if first > chain[1] - length and -length < first - chain[1] <= GAP + 1 and start > chain[2] - length and end > chain[2] and start - chain[2] <= GAP + 1:
                        chain[3] += min(length, last - chain[1], end - chain[2])
                        chain[1], chain[2] = last, end
                        break
                else:
                    open_[k].append([first, last, end, length])
            for k, kept in open_.items():
                closed += [(k, *c) for c in kept if last - c[1] > 4 * GAP + 64]
                open_[k] = [c for c in kept if last - c[1] <= 4 * GAP + 64]
        closed += [(k, *c) for k, kept in open_.items() for c in kept]
        return [(self.names[k], a, b, min(1.0, n / len(self.texts[k]))) for k, a, b, _, n in closed if n >= COVERED * len(self.texts[k])]


_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: 1 where a phrase stands, else the largest share of a template covered by its chain, else 0.
    spans: (label, first_word, last_word, covered) of every chain.
    """
    key = (tuple(phrases.items()), tuple(templates.items()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(phrases, templates)
        scanner = _SCANNERS[key]
        for part in chunks(batches):
            data, offsets = utf8(part.column("text"))
            data = lowered(data)
            starts, ends, first = spans(_LETTER[data], offsets)
            ids = scanner.ids(span_hash(prefix_hash(byte_values(data)), starts, ends))
            # how many runs of the least length begin before each word
            known = ids >= 0
            pair = np.concatenate([[0], np.cumsum(known if scanner.least == 1 else known[1:] & known[:-1])])
            out: list[tuple] = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                places, found = scanner.scan(ids[a:b]) if b - a >= scanner.least and pair[b - scanner.least + 1] > pair[a] else ([], [])
                base = sorted({scanner.names[k] for k, _ in places})
                at = [i for _, i in places]
                score = 1.0 if places else max((x[3] for x in found), default=0.0)
                out.append((b - a, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(x[0] for x in found)})), score, [dict(zip(("label", "first_word", "last_word", "covered"), x, strict=True)) for x in found]))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, last_word long, covered double>>"
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), templates=TEMPLATES | full_texts()).drop("spans")

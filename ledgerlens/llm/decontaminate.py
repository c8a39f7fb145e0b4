"""Operator 9: benchmark decontamination with a BM25 index of the test items and block-max WAND.

Every passage of every training text is a query against an inverted index of the benchmark's items. A passage is
``2 * n`` words long and the next begins ``n`` words on, where n is the longest item's length, so any copy of an item
stands whole in a passage. Impacts are BM25 weights divided by the item's score for its own text: a passage that holds
an item scores 1 or nearly.

The search gives all items of at least ``threshold``, none lost. Items stand in blocks, each with the largest impact
of every word in it. A block whose largest impacts can't reach the threshold is skipped (block-max WAND); which blocks
these are is told for all passages of a chunk at once, first by words alone: words whose largest impacts together
stay under the threshold can't reach it without the other, essential words. In a block that is left, the passage's words
are cursors over their postings, in the order of the items they stand at; the pivot is the first item at which the
block's largest impacts can reach the threshold, and it is scored once all cursors before it have come up. Hits are verified: enough five-word shingles of the whole item, or of its question (all but its answer: the
last sentence, or the last quarter of its words), or of both parts where a question is shorter than a shingle, occur in
the passage. The answer's share is given as a further measure.

A question of five words or more is also an entry of its own in the index, so that a question without its answer is
found whatever the answer's weight. Where an entry's heaviest words could make up more than the threshold leaves, its
own threshold is the least score that a verified hit can have. Document frequencies, the mean length and the passages'
length are those of all items, so hits and scores are the same however many parts the index has.

Defined results: null and wordless texts and items match nothing; an item of fewer than five words matches by its whole
word sequence; equal items each match; repeated rows each get their hits; ties don't matter, as all above the threshold
are given; further columns are ignored by the search and kept by the filter.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, chunks, hash_bytes, is_word, lowered, mixed, only, prefix_hash, span_hash, spans, table, utf8

THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
K1, B = 1.2, 0.75
#: Items to a block, and the most bytes of item text for one index; a larger benchmark is searched in parts.
BLOCK, INDEX_BYTES = 4, 8 << 20
#: Letters, digits and bytes beyond ASCII.
_LETTER = is_word((*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


_stands = itemgetter(0)


def words_of(text: str) -> list[bytes]:
    data = lowered(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = spans(_LETTER[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence that has words if others come before it, else the last quarter of the words."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = [w for p in parts for w in p]
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words, or of the whole if it is shorter."""
    if not len(hashes):
        return hashes
    prefix = prefix_hash(hashes)
    at = np.arange(max(1, len(hashes) - size + 1))
    return np.unique(span_hash(prefix, at, np.minimum(at + size, len(hashes))))


class Statistics:
    """Number of items, their words, the longest item's words, and in how many items each word stands."""

    def __init__(self, texts: Iterable[str | None] = ()):
        self.items, self.words, self.longest, self.frequency = 0, 0, 1, Counter()
        for text in texts:
            words = words_of(text or "")
            self.items += bool(words)
            self.words += len(words)
            self.longest = max(self.longest, len(words))
            self.frequency.update(set(words))

    def weights(self, words: list[bytes]) -> dict[bytes, float]:
        """BM25 weights of an item's words."""
        mean = self.words / max(1, self.items)
        return {w: math.log(1 + (self.items - self.frequency[w] + 0.5) / (self.frequency[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in Counter(words).items()}


class Index:
    """Inverted index of items (item_id, text): an entry for each item, then one for each question of five words or more."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, overlap: float = OVERLAP, statistics: Statistics | None = None):
        items = sorted((i, t) for i, t in items if words_of(t or ""))
        statistics = statistics or Statistics(t for _, t in items)
        parts = [question_and_answer(t) for _, t in items]
        asked = [i for i, (question, answer) in enumerate(parts) if answer and len(question) >= SHINGLE]
        self.of = np.array([*range(len(items)), *asked], np.int64)
        self.item_ids = np.array([items[i][0] for i in self.of], np.int64)
        words = [words_of(t) for _, t in items] + [parts[i][0] for i in asked]
        self.longest = statistics.longest
        vocabulary = sorted({w for ws in words for w in ws})
        hashes = np.array([hash_bytes(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
        self.least = np.full(len(words), threshold)
        postings: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for i, ws in enumerate(words):
            weight = statistics.weights(ws)
            own = sum(weight.values())
            # a shingle that is missing takes away one word at most
            lost = int((1 - overlap) * max(1, len(ws) - SHINGLE + 1) + 1e-9)
            self.least[i] = min(threshold, 1 - sum(sorted(weight.values())[len(weight) - lost :]) / own)
            for w, x in weight.items():
                postings[number[w]].append((i, x / own))
        self.first = np.cumsum([0, *map(len, postings)])
        self.item = np.array([i for p in postings for i, _ in p], np.int32)
        self.impact = np.array([x for p in postings for _, x in p], np.float64)
        self._blocks()
        #: The postings of each word that a search has met.
        self.lists: dict[int, dict[int, tuple[float, list[int], list[float]]]] = {}
        self.parts, self.own = [], []
        for ws, both in zip(words, parts, strict=False):
            hashed = [np.array([hash_bytes(w) for w in part], np.uint64) for part in (ws, *both)]
            self.parts.append([(shingles(x).tolist(), min(SHINGLE, len(x))) for x in hashed])
            weight = statistics.weights(ws)
            self.own.append((np.array([hash_bytes(w) for w in weight], np.uint64), np.array(list(weight.values())) / sum(weight.values())))

    def _blocks(self) -> None:
        """Of each word and block of items: its largest impact there, and whether it is essential there."""
        word = np.repeat(np.arange(len(self.hashes)), np.diff(self.first))
        block = self.item // BLOCK
        self.n_blocks = int(block.max(initial=-1)) + 1
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, len(self.least), BLOCK)) if len(self.least) else self.least
        key = word * max(1, self.n_blocks) + block
        pair, inverse = np.unique(key, return_inverse=True)
        best = np.zeros(len(pair))
        np.maximum.at(best, inverse, self.impact)
        w, b = pair // max(1, self.n_blocks), pair % max(1, self.n_blocks)
        essential = np.zeros(len(pair), bool)
        for i in range(self.n_blocks):
            mine = np.flatnonzero(b == i)
            mine = mine[np.argsort(best[mine], kind="stable")]
            essential[mine[np.cumsum(best[mine]) >= self.block_least[i] - 1e-9]] = True
        self.block_first = np.searchsorted(w, np.arange(len(self.hashes) + 1))
        self.block, self.best, self.essential = b.astype(np.int32), best, essential
        self.has_essential = np.add.reduceat(essential, self.block_first[:-1]) > 0 if len(w) else np.zeros(0, bool)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the index, -1 of others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        where = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[where] == hashes, where, -1)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, first word, last word + 1, entry, score) of each passage's entries above the threshold, for a chunk's words."""
        step, long = self.longest, 2 * self.longest
        number = self.numbers(hashes)
        # passages of each row; a row of any words has one at least
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
        base = np.cumsum(count) - count
        row = np.repeat(np.arange(len(n)), count)
        start = first[:-1][row] + (np.arange(len(row)) - base[row]) * step
        end = np.minimum(start + long, first[1:][row])
        # known words, once in each passage they stand in (two at most)
        at = np.flatnonzero(number >= 0)
        of_row = np.searchsorted(first, at, "right") - 1
        k = (at - first[of_row]) // step
        passage = np.concatenate([base[of_row] + np.minimum(k, count[of_row] - 1), base[of_row] + k - 1])
        words = np.concatenate([number[at], number[at]])
        good = np.concatenate([np.ones(len(at), bool), (k >= 1) & (k <= count[of_row] - 1)])
        passage, words = passage[good], words[good]
        key = np.unique(passage * len(self.hashes) + words) if len(words) else np.zeros(0, np.int64)
        passage, words = key // max(1, len(self.hashes)), key % max(1, len(self.hashes))
        # upper bounds of passages and blocks: first through essential words, which every hit has
        pivot = self.has_essential[words] if len(words) else np.zeros(0, bool)
        p, b, x, e = self._expand(passage[pivot], words[pivot], self.block_first, self.block, self.best, self.essential)
        met = np.zeros(len(row) * self.n_blocks, bool)
        met[(p * self.n_blocks + b)[e]] = True
        meet = np.flatnonzero(met)
        some = met.reshape(len(row), -1).any(axis=1)[passage] if len(met) else np.zeros(len(passage), bool)
        p, b, x, _ = self._expand(passage[some], words[some], self.block_first, self.block, self.best, self.essential)
        key = p * self.n_blocks + b
        on = met[key]
        bound = np.bincount(np.searchsorted(meet, key[on]), x[on], len(meet))
        meet = meet[bound >= self.block_least[meet % max(1, self.n_blocks)] - 1e-9]
        # the passages and blocks that are left
        left = meet // max(1, self.n_blocks)
        begin, stop = np.searchsorted(passage, left), np.searchsorted(passage, left, "right")
        for q, block, a, b in zip(left.tolist(), (meet % max(1, self.n_blocks)).tolist(), begin.tolist(), stop.tolist(), strict=True):
            for i, score in self.wand(words[a:b].tolist(), block):
                yield int(row[q]), int(start[q]), int(end[q]), i, score

    def _postings(self, word: int) -> dict[int, tuple[float, list[int], list[float]]]:
        """Of each block of a word's postings: the largest impact, items, impacts."""
        if word not in self.lists:
            a, b = self.first[word], self.first[word + 1]
            items, impacts = self.item[a:b].tolist(), self.impact[a:b].tolist()
            found: dict[int, tuple[float, list[int], list[float]]] = {}
            for c in range(self.block_first[word], self.block_first[word + 1]):
                block = int(self.block[c])
                x, y = bisect_left(items, block * BLOCK), bisect_left(items, (block + 1) * BLOCK)
                found[block] = float(self.best[c]), items[x:y], impacts[x:y]
            self.lists[word] = found
        return self.lists[word]

    def wand(self, words: list[int], block: int) -> Iterator[tuple[int, float]]:
        """(entry, score) of the block's entries that reach their thresholds, for a passage's distinct words."""
        least, none = float(self.block_least[block]) - 1e-9, (block + 1) * BLOCK
        # where a cursor stands, its place there, and its word's postings
        cursors = [[p[1][0], 0, p] for p in (self._postings(w).get(block) for w in words) if p]

        def move(cursor: list, to: int) -> None:
            items = cursor[2][1]
            cursor[1] = bisect_left(items, to, cursor[1])
            cursor[0] = items[cursor[1]] if cursor[1] < len(items) else none

        while True:
            cursors.sort(key=_stands)
            bound, pivot = 0.0, none
            for c in cursors:
                bound += c[2][0]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot == none:
                return
            score, ready = 0.0, cursors[0][0] == pivot
            for c in cursors:
                if c[0] > pivot or not ready and c[0] == pivot:
                    break
                if ready:
                    score += c[2][2][c[1]]
                move(c, pivot + ready)
            if ready and score >= self.least[pivot] - 1e-9:
                yield pivot, score

    @staticmethod
    def _expand(passage: np.ndarray, words: np.ndarray, first: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        """A row for each entry of each passage's words."""
        n = first[words + 1] - first[words] if len(words) else np.zeros(0, np.int64)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[words] if len(words) else n, n)
        return np.repeat(passage, n), *(c[at] for c in columns)

    def overlap(self, item: int, passage: np.ndarray, known: dict[int, set[int]] | None = None) -> tuple[float, float, float]:
        """The shares of the item's, its question's and its answer's shingles in the passage; an empty part counts as found.

        A part shorter than a shingle is looked for as a whole, with runs of its own length.
        known: the passage's shingles of each size, filled as they are needed.
        """
        known = {} if known is None else known
        for _, size in self.parts[item]:
            if size and size not in known:
                known[size] = set(shingles(passage, size).tolist())
        shares = [sum(x in known[size] for x in part) / len(part) if size else 1.0 for part, size in self.parts[item]]
        return shares[0], shares[1], shares[2]

    def score(self, item: int, passage: np.ndarray) -> float:
        """The whole item's score for the passage."""
        hashes, weight = self.own[item]
        return float(weight[np.isin(hashes, passage)].sum())

    def leaks(self, chunk: pa.RecordBatch, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) of each verified hit: score, question overlap and answer overlap of its best passage."""
        data, offsets = utf8(chunk.column("text"))
        data = lowered(data)
        starts, ends, first = spans(_LETTER[data], offsets)
        hashes = span_hash(prefix_hash(byte_values(data)), starts, ends)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        last, known = -1, {}
        for row, a, b, item in sorted({(row, a, b, int(self.of[entry])) for row, a, b, entry, _ in self.search(hashes, first)}):
            if a != last:
                last, known = a, {}
            whole, question, answer = self.overlap(item, hashes[a:b], known)
            alone = self.parts[item][1][1] >= SHINGLE
            if whole >= overlap or question >= overlap and (alone or answer >= overlap):
                best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (self.score(item, hashes[a:b]), question, answer))
        return best


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[bytes]:
    """The test items are a stated query set: it is indexed in parts of INDEX_BYTES of text or so, one at a time."""
    items = only(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // INDEX_BYTES))
    statistics = Statistics(r.text for r in items.select("text").toLocalIterator())
    for k in range(parts):
        yield pickle.dumps(Index([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()], threshold, overlap, statistics))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the best passage of each verified hit of each row."""
    rows, found = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), None
    for index in indexes(benchmark, threshold, overlap):
        of = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(of.value)
            for chunk in chunks(batches):
                best = index.leaks(chunk, overlap)
                values = list(zip(*best.values(), strict=True)) or [(), (), ()]
                ids = index.item_ids[np.array([i for _, i in best], np.int64)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id").take(pa.array([r for r, _ in best], pa.int64())), pa.array(ids), *(pa.array(v, pa.float64()) for v in values)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(scan, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs without a verified hit, with their columns."""
    for index in indexes(benchmark, threshold, overlap):
        of = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(of.value)
            for batch in batches:
                bad, base = np.zeros(batch.num_rows, bool), 0
                for chunk in chunks(iter([batch.select(["text"])])):
                    bad[[base + r for r, _ in index.leaks(chunk, overlap)]] = True
                    base += len(chunk)
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
